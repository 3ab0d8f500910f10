"""Queries that do the whole job of their operator, against brute force on small tables."""

import numpy as np

from tessera.operators import relational, vectors
from tessera.plans import all_queries


def test_conflicting_objects_far_apart(spark, tmp_path):
    items = [(1, 5), (1, 900), (1, 900), (1, 70), (2, 4), (3, 8), (3, 9)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, all_queries.QUERIES["conflicting_objects"](spark, str(tmp_path)).collect()))
    assert got == [(1, 5, 70, 2), (1, 70, 5, 2), (1, 900, 5, 2), (3, 8, 9, 1), (3, 9, 8, 1)]


def test_others_hold_values_once(spark):
    """Nulls are no values, and the last step has one join of values with their groups' sums."""
    rows = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("a", None), ("b", 5), ("b", None), (None, 1), (None, 2), ("c", 2), ("c", 9), ("c", 4)], "g string, v long")
    out = relational.others(rows, ["g"], "v")
    assert sorted(map(tuple, out.collect())) == [("a", 1, 3, 1), ("a", 3, 1, 1), ("c", 2, 4, 2), ("c", 4, 2, 2), ("c", 9, 2, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_contradicting_texts_of_other_documents(spark, tmp_path):
    docs = [(k, "Stone is grey. Green is it. Rivers run. Stone is green.") for k in (1, 2, 6)] + [(11, "Stone is old.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    facts = [(d * 10000 + p, x.rstrip("."), x.split()[0].lower(), (d * 10000 + p) * 37 % 100 / 100) for d, t in docs for p, x in enumerate(t.split(". "))]
    want = []
    for a, text, value, _ in facts:
        other = [(-c, b) for b, t, v, c in facts if b % 5 == a % 5 and v == value and t != text]
        if other:
            want.append((a, min(other)[1], len(other)))
    got = all_queries.QUERIES["contradiction_pairs"](spark, str(tmp_path)).where("kind = 'text'").collect()
    assert sorted((x.a, x.b, x.links) for x in got) == sorted(want)
    assert any(a // 10000 != b // 10000 for a, b, _ in want)


def test_cosine_knn_in_blocks(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((60, 5))
    x[7] = 0
    x[9] = x[8] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    q = df.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "v AS q")
    n = np.linalg.norm(x, axis=1)
    c = np.where(np.outer(n, n) > 0, x @ x.T / np.maximum(np.outer(n, n), 1e-12), 0)
    want = {i: sorted((-round(c[i, j], 9), j) for j in range(60) if j != i)[:4] for i in range(0, 60, 3)}
    for block in (2000, 7):
        got = vectors.cosine_neighbours(q, df, 4, block).collect()
        assert {i: [(-round(y.cosine, 9), y.vec_id) for y in sorted((y for y in got if y.query_id == i), key=lambda y: y.rank)] for i in want} == want
