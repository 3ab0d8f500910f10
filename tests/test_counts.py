"""Vectors of counts that are met in blocks, against plain loops and SQL."""

import duckdb
import numpy as np
from tessera.operators import threshold_join as J


def test_counts_are_met_in_blocks(spark, monkeypatch):
    """Every pair of a cell is met whatever the blocks are, products that single precision can't hold among them; the strongest of a row leaves its task alone."""
    rng = np.random.default_rng(6)
    v = rng.integers(0, 4, (90, 12)) + 1
    v[::9] *= 3001  # too large for single precision
    v[40:50] = v[50:60]  # ties
    rows = [(int(n % 3 == 0), n, x.tolist()) for n, x in enumerate(v)]
    kind = "cell int, id long, v array<int>"
    left, right = spark.createDataFrame(rows[:55], kind), spark.createDataFrame(rows[55:] + [(7, 900, v[0].tolist())], kind)
    norm = [int((x.astype(object) ** 2).sum()) ** 0.5 for x in v]
    want = {(a, b): float(v[a] @ v[b]) / norm[a] / norm[b] for a in range(55) for b in range(55, 90) if (a % 3 == 0) == (b % 3 == 0)}
    want = {k: c for k, c in want.items() if c > 0.85}
    monkeypatch.setattr(J, "LEAST", 1)
    for block, chunk in ((J.BLOCK, J.STREAM), (4, 3)):
        got = {(r.a, r.b): r.c for r in J.met_counts(left, right, 0.85, J.pairs_of, "a long, b long, c double", block=block, chunk=chunk).collect()}
        assert got == want
        best = J.met_counts(left, right, 0.85, J.strongest_of, "a long, b long, c double, n long", block=block, chunk=chunk).collect()
        if block > 4:
            assert {r.a: (-r.c, r.b, r.n) for r in best} == {a: (*min((-c, b) for (x, b), c in want.items() if x == a), sum(x == a for x, _ in want)) for a in {a for a, _ in want}}
        assert sum(r.n for r in best) == len(want) and len(best) < len(want)
    assert J.met_counts(left.limit(0), right, 0.85, J.pairs_of, "a long, b long, c double").count() == 0


def test_opposed_documents(spark, tmp_path, monkeypatch):
    """Ids that come twice count as one document, and contradictions by meaning make no pairs of documents on their way."""
    import __spark_entry__ as entry
    from tessera.plans import knowledge_queries as K

    texts = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "Alpha, beta. Gamma delta!", None, "the of", "zeta eta theta"]
    docs = [(d, texts[d % 6], "s", "en") for d in range(84)] + [(70, "zeta eta", "s", "en"), (None, texts[0], "s", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    made = []
    plain = K.met_counts
    monkeypatch.setattr(K, "met_counts", lambda *a: made.append(plain(*a)) or made[-1])
    for name in ("semantic_contradictions", "all_contradictions"):
        out = queries[name](spark, str(tmp_path))
        want = db.execute(sql[name]).fetchall()
        assert sorted(map(tuple, out.collect())) == sorted(want) and want
    pairs, each = made
    assert each.count() < pairs.count()


def test_means_read_their_points_once(spark, monkeypatch):
    """No round of means maps vectors into the ball again, and a vector's norm is taken once, not for each component."""
    from pyspark.sql import functions as F
    from tessera.functions import geometry as G
    from tessera.operators import vectors as V

    seen = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 6)) * 0.3
    rows = [(n, "ab"[n % 2], v.tolist()) for n, v in enumerate(x)] + [(90, None, x[0].tolist()), (91, "a", None)]

    @F.udf("array<double>")
    def noted(v):
        seen.add(1)
        return v

    p = spark.createDataFrame(rows, "vec_id long, label string, v array<double>").select("vec_id", "label", noted.asNondeterministic()("v").alias("p"))
    got = {r["label"]: r["mean"] for r in V.frechet_mean(p, "label", rounds=8).collect()}
    assert seen.value <= len(rows)
    for k in "ab":
        m, mine = np.zeros(6), x[[n for n in range(40) if "ab"[n % 2] == k]]
        for _ in range(8):
            m = V.exp_mu(m, 0.5 * V.log_mu(m, mine).mean(0))
        assert np.allclose(got[k], m, atol=1e-12)
    plan = spark.createDataFrame(rows, "vec_id long, label string, v array<double>").select(G.exp0(F.col("v")).alias("p"))
    out = plan.collect()
    n = np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.array([r.p for r in out[:40]]), x * np.tanh(n / 2) / n) and out[41].p is None


def test_modularity_sums_its_graph_up_once(spark, monkeypatch):
    """Neither the second start nor the comparison of partitions sums edges up again, and single nodes need no contracted graph."""
    from tessera.operators import modularity as M

    calls, plain = [], M.weighted
    monkeypatch.setattr(M, "weighted", lambda e: calls.append(1) or plain(e))
    clique = lambda n: [(a, b, 1) for a in range(n, n + 4) for b in range(n, a)]
    edges = clique(0) + clique(10) + [(0, 10, 1), (10, 0, 1), (3, 3, 2)]
    found = M.modularity_communities(spark.createDataFrame(edges, "src long, dst long, weight long")).collect()
    assert len(calls) == 1
    assert len({r.community for r in found if r.node < 10}) == len({r.community for r in found if r.node >= 10}) == 1 and len({r.community for r in found}) == 2
