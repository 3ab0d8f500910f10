"""The topic index against brute force, queues and name rules on small tables."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as V
from tessera.operators import vectors
from tessera.streaming import queues as Q


def test_topic_index(spark, tmp_path):
    r = np.random.default_rng(2)
    x = r.standard_normal((200, 4)) * 0.2
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, p array<double>")
    V.build_topic_index(p, str(tmp_path / "index"), 6)
    asked = p.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("p").alias("q"))
    got = sorted((a.query_id, a.cluster, a.vec_id) for a in V.query_topic_index(asked, str(tmp_path / "index"), 2, 3).collect())
    centres = np.array([c.p for c in spark.read.parquet(str(tmp_path / "index/centroids")).orderBy("cluster").collect()])
    home = vectors.ball_distances(x, centres).argmin(1)
    want = []
    for i in range(0, 200, 40):
        d = vectors.ball_distances(x[i : i + 1], x)[0]
        for c in np.argsort(vectors.ball_distances(x[i : i + 1], centres)[0], kind="stable")[:2]:
            want += [(i, int(c), int(j)) for j in sorted(np.flatnonzero(home == c), key=lambda j: (d[j], j))[:3]]
    assert got == sorted(want)


def test_queue_keeps_each_content_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, "")], "k int, v string")
    for n in range(3):  # three files, one a batch
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "queue")
    got = Q.enqueue(stream, ["k", "v"], path).collect()
    assert sorted((x.k, x.v or "") for x in got) == [(1, "a"), (2, "")]
    assert Q.enqueue(stream, ["k", "v"], path).count() == 2  # nothing new: nothing comes again


def test_breaker_and_retries(spark):
    rows = [("a", n, s) for n, s in enumerate("ffsfff")] + [("b", 0, "s"), ("c", 0, "f")]
    df = spark.createDataFrame(rows, "key string, n int, s string")
    got = {(x.key, x.n): (x.in_row, x.open) for x in Q.breaker(df, "key", ["n"], F.col("s") == "f", 3).collect()}
    assert [got["a", n][0] for n in range(6)] == [1, 2, 0, 1, 2, 3] and [k for k, v in got.items() if v[1]] == [("a", 5)]
    assert {x.key for x in Q.due_again(df, "key", "n", "s", "s", 6).collect()} == {"c"}


def test_names(spark):
    df = spark.createDataFrame([("  ada \t king ",), ("cher",), ("st. john's, nl",)], "x string")
    assert [(r.p, r.l) for r in df.select(T.person_name(F.col("x")).alias("p"), T.location_name(F.col("x")).alias("l")).collect()][1:] == [("Cher", "Cher"), ("st. john's, nl", "St Johns Nl")]


def test_term_scores(spark, monkeypatch):
    """Chunks, facts and the linear ranker against plain loops; a pair of row and query is never a row, and blocks of queries change nothing."""
    rng = np.random.default_rng(4)
    pool = [a + b for a in ("ka", "lomi", "tusen", "prazenit") for b in ("", "ro", "venk", "straiteln")]
    text = lambda n: " ".join(rng.choice(pool, n))
    docs = [(d, text(rng.integers(0, 40))) for d in range(60)] + [(60, None), (61, "The KA!lomiéka")]
    asked = [(q, text(rng.integers(0, 14))) for q in range(9)] + [(9, docs[3][1]), (10, None), (11, "the of")]
    facts = [(d * 10 + p, d, " ".join((t or "").split()[p::3]), round(float(rng.random()), 2)) for d, t in docs for p in range(3)]
    words = lambda t: [w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (t or "").lower()).split() if len(w) > 1 and w not in T.STOP_WORDS]
    first = {q: list(dict.fromkeys(words(t)))[:10] for q, t in asked}
    best = lambda x: {q: [(r, k, round(s, 6)) for r, (s, k) in enumerate(sorted(v, key=lambda y: (-round(y[0], 6), y[1]))[:4], 1)] for q, v in x.items() if v}
    held, chunk, fact, linear = {d: set(words(t)) for d, t in docs}, {}, {}, {}
    for q, t in asked:
        w = first[q]
        phrase = words(t)[:4]
        stands = lambda x: len(phrase) == 4 and any(x[i : i + 4] == phrase for i in range(len(x)))  # noqa: B023, E731
        chunk[q] = [(sum(max(1, len(x) / 4) for x in w if x in held[d]) + 8 * stands(words(t)), d) for d, t in docs if held[d] & set(w)]
        fact[q], linear[q] = [], []
        for f, d, t, c in facts:
            have = set(words(t))
            if hits := len(have & set(w)):
                fact[q].append((0.6 * c + 0.4 * hits / len(w), f))
                rare = [x for x in w if len(x) >= 6]
                parts = {"overlap": hits / len(w), "rare": len(have & set(rare)) / max(len(rare), 1), "semantic": hits / (len(w) * len(have)) ** 0.5, "graph": len(have & set(w[:3])) / min(len(w), 3), "salience": V.SALIENCE, "document": len(held[d] & set(w)) / len(w), "type": V.FACT_PRIOR, "confidence": c}
                linear[q].append((sum(V.WEIGHTS[n] * x for n, x in parts.items()), f))
    got = lambda df, key: {q: sorted((r["rank"], r[key], r["score"]) for r in rows) for q, rows in _by(df.collect(), "q").items()}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "q long, text string")
    f = spark.createDataFrame(facts, "fact_id long, doc_id long, text string, confidence double")
    from tessera.operators import term_scores

    for queries, cells in ((2000, 1 << 20), (5, 20)):
        monkeypatch.setattr(term_scores, "QUERIES", queries)
        monkeypatch.setattr(term_scores, "CELLS", cells)
        out = V.search_chunks(d, b, "doc_id", "q", 4)
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert got(out, "doc_id") == best(chunk)
        assert got(V.search_facts(f, b, "q", 4), "fact_id") == best(fact)
        assert got(V.rank_facts(f, d, b, "q", 4), "fact_id") == best(linear)
    assert got(V.search_chunks(d, b.limit(0), "doc_id", "q", 4), "doc_id") == {}


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_tokens_are_cut_in_one_step(spark):
    """As replacing each other character by a space and cutting at white space, without replacing any."""
    rows = [("",), (None,), (" a bc",), ("déjà-vu x1\t\x0b\x1cZZ top end.",), ("the İstanbul 𝒳yz ab😀cd",), ("--",)]
    df = spark.createDataFrame(rows, "x string")
    old = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("x", F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*T.STOP_WORDS))
    out = df.select(T.tokenize(F.col("x")).alias("a"))
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.a for r in out.collect()] == [r.a for r in df.select(old.alias("a")).collect()]


def test_topic_members_are_met_in_blocks(spark, tmp_path):
    """A cluster's queries and members never become rows of pairs; copies of a vector go by vec_id."""
    x = [[0.1, 0.2], [0.1, 0.2], [0.1, 0.2], [0.3, -0.2], [-0.4, 0.1], [0.1, 0.2]]
    p = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, p array<double>")
    V.build_topic_index(p, str(tmp_path / "index"), 1)
    out = V.query_topic_index(p.where("vec_id IN (2, 4)").selectExpr("vec_id AS query_id", "p AS q"), str(tmp_path / "index"), 1, 3)
    got = {k: [(r.vec_id, round(r.distance, 9)) for r in sorted(v, key=lambda r: (r.distance, r.vec_id))] for k, v in _by(out.collect(), "query_id").items()}
    far = round(float(vectors.ball_distances(np.array([x[4]]), np.array([x[0]]))[0, 0]), 9)
    assert got == {2: [(0, 0.0), (1, 0.0), (2, 0.0)], 4: [(4, 0.0), (0, far), (1, far)]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner, (cluster" not in plan


def test_edges_that_are_read_many_times_are_written_once(spark, monkeypatch, tmp_path):
    """Neither the layers of a replayed run nor label propagation sum line items up again."""
    from tessera.operators import modularity
    from tessera.plans import knowledge_queries as K

    items = [(s, p) for s in range(6) for p in range(9) if (s * p) % 4 < 2]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    plans = []
    seen = lambda f: lambda e, *more: plans.append(e._jdf.queryExecution().optimizedPlan().toString()) or f(e, *more)
    monkeypatch.setattr(K, "layered", seen(K.layered))
    monkeypatch.setattr(modularity, "communities", seen(modularity.communities))
    assert K.replayed_run(spark, str(tmp_path)).first()["agrees"]
    assert K.keyword_modularity(spark, str(tmp_path)).count() == len({s for s, _ in items}) + len({p for _, p in items})
    assert len(plans) == 3 and not any("Aggregate" in p for p in plans)


def test_linear_ranker_takes_all_words_of_a_passage(spark, tmp_path):
    """A fact that holds only a passage's last words is found, and ranks above one with a single word of its beginning; as in the SQL."""
    import __spark_entry__ as entry
    import duckdb

    pool = [a + b for a in ("ka", "lomi", "tusen") for b in ("ro", "venk", "straiteln", "mopra")]
    docs = [(1, pool[0] + " elsewhere."), (2, " ".join(pool[10:]) + ". " + pool[10] + " again."), (3, "nothing here"), (4, " ".join(pool))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(pool)), (2, None), (3, pool[11])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()["linear_ranking"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(entry.oracle_sql()["linear_ranking"]).fetchall())
    assert [f for q, _, f, _ in got if q == 1] == [40000, 20000, 20001, 10000]


def test_terms_of_many_long_queries():
    """So many words that four of them have no code in 64 bits."""
    from tessera.operators.term_scores import Terms

    t = Terms([(q, [f"w{q}x{n}" for n in range(600)]) for q in range(100)], None, None, False)
    assert len(t.words) == 60_000 and t.n.tolist() == [600] * 100 and t.named.all()
