"""Windows in update mode: later batches bring newer versions, and rows behind the watermark no longer count."""

from datetime import datetime, timedelta

from tessera.streaming import events as E


def test_late_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    kinds = "event_id long, ts timestamp, user_id long, event_type string, value double"
    batches = [[(0, 1.0), (10, 2.0)], [(30, 4.0), (200, 8.0)], [(205, 64.0)], [(20, 16.0), (190, 32.0)]]  # minutes and values
    path = str(tmp_path / "in")
    for n, b in enumerate(batches):
        rows = [(10 * n + k, start + timedelta(minutes=m), 1, "view", v) for k, (m, v) in enumerate(b)]
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(path)
    like = spark.createDataFrame([], kinds)
    out = E.drain(E.tumbling(E.source(spark, path, like, files=1), late="1 hour"), "late", "update", keys=["start", "event_type"]).collect()
    got = {x.start.hour: (x.n, x.total) for x in out}
    # minute 20 comes when the watermark has been past its hour (200 - 60 minutes) for a batch; minutes 190 and 205 still count
    assert got == {0: (3, 7.0), 3: (3, 104.0)}
