"""The versioned vector index, the ledger of runs, and state with timers and times to live."""

import time

import pytest
from pyspark.sql import functions as F
from tessera.operators.provenance import Ledger, compared, exact_digest
from tessera.operators.vector_index import VectorIndex
from tessera.streaming import expiring as X


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, v array<double>")


def held(df):
    return {r.vec_id: tuple(r.v) for r in df.collect()}


def test_index_rebuilds_only_changed_cells(spark, tmp_path):
    rows = {k: (k, 1.0, 2.0) for k in range(60)}
    index = VectorIndex(spark, str(tmp_path), 3, cells=6)
    assert index.version() is None and index.read().count() == 0
    assert len(index.refresh(vectors(spark, rows.items()))) == 6 and held(index.read()) == rows
    assert index.refresh(vectors(spark, reversed(rows.items())).repartition(4)) == [] and index.versions() == [1]
    before, old = index.version(), index.read()
    rows[7] = (7.5, 1.0, 2.0)
    changed = index.refresh(vectors(spark, rows.items()))
    after = index.version()
    assert len(changed) == 1 and after.number == 2
    assert {c for c in after.cells if after.cells[c]["path"] != before.cells[c]["path"]} == set(changed)
    # the reader that began before the swap still sees its version, and so does one that asks for it
    assert held(old)[7] == (7.0, 1.0, 2.0) == held(index.read(1))[7] and held(index.read()) == rows
    assert len(index.append(vectors(spark, [(7, (0, 0, 0)), (100, (1, 1, 1)), (101, (1, 1))]))) <= 2
    assert held(index.read()) == rows | {7: (0, 0, 0), 100: (1, 1, 1)} and index.append(vectors(spark, []).limit(0)) == []
    del rows[7]
    index.refresh(vectors(spark, rows.items()))
    assert held(index.read()) == rows


def test_dimensions_do_not_mix_and_second_writers_fail(spark, tmp_path):
    two, three = VectorIndex(spark, str(tmp_path), 2), VectorIndex(spark, str(tmp_path), 3)
    both = vectors(spark, [(1, (1, 2)), (2, (1, 2, 3)), (None, (1, 2))])
    two.refresh(both)
    three.refresh(both)
    assert held(two.read()) == {1: (1, 2)} and held(three.read()) == {2: (1, 2, 3)}
    with pytest.raises(RuntimeError, match="another writer"):
        two._commit(1, {})
    assert held(two.read()) == {1: (1, 2)}


def test_ledger_names_what_changed(spark):
    t = spark.createDataFrame([(1, "a", None), (2, None, 0.5), (2, None, 0.5)], "k long, s string, x double")
    ledger = Ledger(spark)
    first = ledger.record("one", {"t": t}, {"rate": 0.5, "names": ["b"]}, {"out": t.select("k")})
    assert ledger.record("two", {"t": t.repartition(3).orderBy(F.desc("k"))}, {"names": ["b"], "rate": 0.5}, {"out": t.select("k")}) == first
    assert ledger.differences("one", "two") == []
    ledger.record("three", {"t": t.fillna({"s": ""})}, {"rate": 0.6, "names": ["b"]}, {"out": t.select("k")})
    assert ledger.differences("one", "three") == ["input:t", "parameter:rate"]
    ledger.record("four", {"t": t}, {"names": ["b"]}, {"out": t.select("k").limit(1), "more": t})
    assert ledger.differences("one", "four") == ["parameter:rate", "output:more", "output:out"]
    assert exact_digest(t.limit(0)).first()[0] == 0
    with pytest.raises(Exception, match="(?i)exist"):
        ledger.record("one", {}, {}, {})


def test_replay_within_a_tolerance(spark):
    a = spark.createDataFrame([(k, k * 0.5) for k in range(200)] + [(None, None)], "k long, x double")
    b = a.withColumn("x", F.when(F.col("k") == 3, F.col("x") + 1e-9).when(F.col("k") == 4, F.col("x") + 0.25).otherwise(F.col("x"))).where("k IS NULL OR k != 9")
    r = compared(a, b, ["k"], ["x"]).first()
    assert (r.n_a, r.n_b, r.only_a, r.only_b, r.apart, r.largest, r.agrees) == (201, 200, 1, 0, 1, 0.25, True)
    assert not compared(a, b.where("k < 150"), ["k"], ["x"]).first().agrees and compared(a.limit(0), b.limit(0), ["k"], ["x"]).first().agrees


def fed(spark, path, rows, schema):
    """A stream of a file for each of `rows`, with the seconds of ts."""
    for n, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{path}/{n:03d}")
        time.sleep(0.05)
    return add(spark, path, schema)


def add(spark, path, schema):
    plain = spark.createDataFrame([], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").schema
    return spark.readStream.schema(plain).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def seconds(df, *columns):
    return sorted(tuple(int(r[c].timestamp()) if c in ("started", "ended", "since") else r[c] for c in columns) for r in df.collect())


def test_sessions_end_by_timers_and_go_on_over_batches(spark, tmp_path):
    rows = [[(1, "ann", 10), (1, "bob", 20), (2, "cem", 15)], [(1, "ann", 60), (2, "dee", 200)], [(2, "eve", 230), (1, "ann", 400)], [(3, "far", 5000)]]
    stream = fed(spark, tmp_path, rows, "key long, name string, t long").withWatermark("ts", "0 seconds")
    out = X.run(stream, X.ActiveNames(100_000), X.SESSION, "test")
    assert seconds(out, "key", "started", "ended", "n", "names") == [(1, 10, 60, 3, "ann,bob"), (1, 400, 400, 1, "ann"), (2, 15, 15, 1, "cem"), (2, 200, 230, 2, "dee,eve")]


def test_verifier_trails_the_latest_item(spark, tmp_path):
    rows = [[(1, "draft", 10), (2, "only", 12)], [(1, "second", 50)], [(1, "third", 90), (3, "late", 95)], [(9, "end", 3000)]]
    stream = fed(spark, tmp_path, rows, "key long, item string, t long").withWatermark("ts", "0 seconds")
    out = X.run(stream, X.TrailingVerifier(60_000), X.DUE, "test")
    assert seconds(out, "key", "item", "since") == [(1, "third", 90), (2, "only", 12), (3, "late", 95)]


def test_cached_values_expire_and_go_on_from_a_checkpoint(spark, tmp_path):
    schema, base, fold = "key long, value double, t long", str(tmp_path / "base"), tmp_path / "in"
    stream = fed(spark, fold, [[(1, 1.5, 1), (1, 9.0, 2), (2, 4.0, 5)], [(1, 2.5, 30)]], schema).withWatermark("ts", "0 seconds")
    first = X.run(stream, X.ExpiringCache(60_000), X.CACHED, "test", base)
    assert sorted(map(tuple, first.collect())) == [(1, 1.5, False), (1, 1.5, True), (1, 1.5, True), (2, 4.0, False)]
    spark.createDataFrame([(1, 7.0, 100), (2, 3.0, 64)], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{fold}/002")
    again = X.run(add(spark, fold, schema).withWatermark("ts", "0 seconds"), X.ExpiringCache(60_000), X.CACHED, "test", base)
    assert sorted(map(tuple, again.collect())) == [(1, 1.5, False), (1, 1.5, True), (1, 1.5, True), (1, 7.0, False), (2, 4.0, False), (2, 4.0, True)]


def test_queue_keeps_the_first_of_each_content(spark, tmp_path):
    from tessera.streaming.queues import enqueue, runs

    for n in range(40):
        assert [k for a, z in runs(n) for k in range(a, z + 1)] == list(range(n)) and len(runs(n)) == n.bit_count()
    batches = [[(k % 5, n, n)] + [(100 + n, n, n)] * 2 for n, k in enumerate([0, 1, 0, 2, 7, 3, 1])]
    stream = fed(spark, tmp_path / "in", batches, "item long, batch long, t long")
    got = sorted((r["item"], r["batch"]) for r in enqueue(stream, ["item"], str(tmp_path / "queue")).collect())
    first = {}
    for rows in batches:
        for item, batch, _ in rows:
            first.setdefault(item, batch)
    assert got == sorted(first.items())
