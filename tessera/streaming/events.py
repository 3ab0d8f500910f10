"""Structured Streaming over the events table: windows with watermarks, sessions, deduplication, state, mini-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


def source(spark: SparkSession, pattern: str, like: DataFrame, files: int = 100) -> DataFrame:
    """A stream of Parquet files that match a pattern, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Counts and sums for each event type and window; state older than the watermark goes."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 hours", slide: str = "1 hour", late: str = "30 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first of the events that agree in keys within the watermark; state is kept no longer."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def decayed_state(events: DataFrame, rate: float = 0.3) -> DataFrame:
    """(user_id, n, x): per user how many events came, and a mean that forgets, in the order of event_id; kept in state between batches.

    Events may come in any order, within a batch and between batches. A value weighs (1 - rate) ** k once
    k others follow it, so state keeps the last values, as many as weigh more than 1e-30 (193 at 0.3);
    what is older can't change x. Any null makes x null.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    most = ceil(log(1e-30) / log(1 - rate)) if 0 < rate < 1 else 1 << 30

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, lost, ids, values = state.get if state.exists else (0, False, [], [])
        ids, values = np.array(ids, np.int64), np.array(values, float)
        for b in batches:
            n, lost = n + len(b), lost or bool(b["value"].isna().any())
            ids, values = np.concatenate([ids, b["event_id"].to_numpy(np.int64)]), np.concatenate([values, b["value"].to_numpy(float)])
            order = np.argsort(ids, kind="stable")[-most:]
            ids, values = ids[order], values[order]
        x = values[0]
        for v in values[1:]:
            x = (1 - rate) * x + rate * v
        state.update((n, lost, ids.tolist(), values.tolist()))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "x": [None if lost else float(x)]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, x double", "n long, lost boolean, ids array<long>, seen array<double>", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder (or through `each` batch), and read that.

    keys: what a row is known by, where batches bring newer versions of it (update mode); the last one counts.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        # a batch that runs again writes the same folder again
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(each or put).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    out = spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*")
    if not keys:
        return out
    number = F.regexp_extract(F.input_file_name(), r"/batch=([0-9]+)/", 1).cast("long")
    latest = out.withColumn("__batch", number).groupBy(*keys).agg(F.max_by(F.struct(*(c for c in out.columns if c not in keys)), "__batch").alias("__row"))
    return latest.select(*keys, "__row.*").select(*out.columns)


def centroids(stream: DataFrame, key: str, value: str, keep: float = 0.9) -> DataFrame:
    """(key, centroid) after all that is there: each mini-batch leaves a centroid `keep` of itself and adds the rest of the batch's mean.

    State is a table per batch in the shared folder, made from the one before; a
    batch that runs again writes the same table again. Nothing comes to the driver.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/centroids-{uuid.uuid4().hex}"
    kind = stream.schema[key].dataType.simpleString()
    last = -1

    def read(session: SparkSession, n: int) -> DataFrame:
        return session.read.schema(f"{key} {kind}, centroid double").parquet(f"{base}/state/batch={n}")

    def put(batch: DataFrame, n: int) -> None:
        nonlocal last
        means = batch.groupBy(key).agg(F.avg(value).cast("double").alias("m"))
        out = means.withColumnRenamed("m", "centroid")
        if n:
            moved = F.when(F.col("m").isNull(), F.col("centroid")).when(F.col("centroid").isNull(), F.col("m")).otherwise(keep * F.col("centroid") + (1 - keep) * F.col("m"))
            out = read(batch.sparkSession, n - 1).join(means, key, "full").select(key, moved.alias("centroid"))
        out.write.mode("overwrite").parquet(f"{base}/state/batch={n}")
        last = n

    q = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return read(spark, last) if last >= 0 else spark.createDataFrame([], f"{key} {kind}, centroid double")


def refresh_centroids(batch: DataFrame, centroids: dict[str, float], keep: float = 0.9) -> dict[str, float]:
    """Mini-batch update of a few centroids on the driver: each keeps 0.9 of itself and takes 0.1 of the batch's mean."""
    means = {r["event_type"]: r["m"] for r in batch.groupBy("event_type").agg(F.avg("value").alias("m")).collect()}
    return centroids | {k: keep * centroids[k] + (1 - keep) * m if k in centroids else m for k, m in means.items()}
