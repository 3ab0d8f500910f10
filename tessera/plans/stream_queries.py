"""Streams over events (T1 to T4), drained and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as E
from .registry import load, query


def stream(spark: SparkSession, sf: str) -> DataFrame:
    return E.source(spark, f"{sf}/event[s].parquet", load(spark, sf, "events"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.drain(E.tumbling(stream(spark, sf)), "tumbling", "update", keys=["start", "event_type"]).withColumn("total", F.round("total", 3))


@query("SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour' * k AS start FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY start")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.drain(E.sliding(stream(spark, sf)), "sliding", "update", keys=["start"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.drain(E.sessions(stream(spark, sf)), "sessions", "complete")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    d = E.drain(E.deduplicated(stream(spark, sf), ["user_id", "event_type"], "3650 days"), "distinct")
    return d.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY event_id), lambda x, v: 0.7 * x + 0.3 * v), 4) AS x FROM events GROUP BY user_id")
def user_state(spark: SparkSession, sf: str) -> DataFrame:
    return E.drain(E.decayed_state(stream(spark, sf)), "state", "update", keys=["user_id"]).withColumn("x", F.round("x", 4))
