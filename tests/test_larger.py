"""Faults that larger tables showed: empty partitions, sums beyond 63 bits, rows out of order, work that grows faster than its input."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.operators import vectors as V
from tessera.operators.provenance import table_digest
from tessera.operators.threshold_join import COPIES, copied
from tessera.streaming import events as E
from tessera.streaming.expiring import ActiveNames


class Held:
    """A list state, and the handle that gives it."""

    def __init__(self):
        self.rows = []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.at = at

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def test_ended_sessions_come_in_one_table():
    p, start = ActiveNames(1000), datetime(2024, 1, 1)
    p.init(Held())
    rows = pd.DataFrame({"name": ["b", "a"] * 500, "ts": [start + timedelta(seconds=10 * (k // 2)) for k in range(1000)]})
    tables = list(p.handleInputRows((7,), iter([rows]), None))
    assert len(tables) == 1 and len(tables[0]) == 499 and set(tables[0]["names"]) == {"a,b"} and tables[0]["n"].sum() == 998
    assert tables[0]["started"].iloc[1] == pd.Timestamp(start + timedelta(seconds=10)) and len(p.held.rows) == 2


def test_means_of_empty_partitions(spark):
    rows = [(k, k % 2, [0.1 * k, 0.2]) for k in range(4)] + [(4, None, [0.1, 0.1]), (5, 1, None)]
    p = spark.createDataFrame(rows, "vec_id long, label int, p array<double>").repartition(16)
    got = {r["label"]: r["mean"] for r in V.frechet_mean(p, "label", rounds=60).collect()}
    assert sorted(got) == [0, 1] and 0 < got[0][0] < 0.2 and 0.1 < got[1][0] < 0.3


def test_digest_beyond_63_bits(spark):
    n = 100_000
    want = sum(int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16) for k in range(n))
    assert want > 1 << 63
    assert tuple(table_digest(spark.range(n)).first()) == (n, want % (1 << 63))
    assert tuple(table_digest(spark.range(0)).first()) == (0, 0)


@pytest.mark.parametrize("files", [1, 9])
def test_decayed_state_in_order_of_events(spark, tmp_path, files):
    path, n = str(tmp_path / "in"), 900
    value = lambda k: float(k * 7919 % 101)
    for part in (2, 0, 1):  # later batches bring earlier events
        rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=k), 1, value(k)) for k in range(n) if k % 3 == part]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.mode("append").parquet(path)
    like = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, value double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = E.drain(E.decayed_state(E.source(spark, path, like, files=files)), "order", "update", keys=["user_id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    x = value(0)
    for k in range(1, n):
        x = 0.7 * x + 0.3 * value(k)
    assert [(r["user_id"], r["n"]) for r in got] == [(1, n)] and got[0]["x"] == pytest.approx(x, abs=1e-9)


def test_blocks_of_queries_meet_chunks_of_points(spark):
    """No pair is worked out by expressions: counts and smallest distances come from matrix products, over several blocks."""
    x = np.random.default_rng(1).uniform(-0.3, 0.3, (90, 4))
    p = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, p array<double>")
    q = p.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("p").alias("q"), F.lit(0.6).alias("radius"))
    d = V.ball_distances(x, x)
    near = (d <= 0.6).sum(1) - 1
    got = {r["query_id"]: r["inside"] for r in V.inside(q, p, block=5).collect()}
    assert got == {k: near[k] for k in range(0, 90, 4) if near[k]}
    least = {r["vec_id"]: r["d"] for r in V.closest(q, p.where("vec_id % 4 != 0"), block=5).collect()}
    assert set(least) == {k for k in range(90) if k % 4} and all(abs(v - d[k, ::4].min()) < 1e-9 for k, v in least.items())


def test_copies_leave_a_task_in_small_batches():
    b = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[float(k)] for k in range(100)])], ["id", "v"])
    row, cell = np.nonzero(np.ones((100, 256)))
    got = list(copied(b, row, cell))
    assert max(x.num_rows for x in got) <= COPIES
    assert [(i, c) for x in got for i, c in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), strict=True)] == list(zip(row.tolist(), cell.tolist(), strict=True))
