"""The search index against brute force: prefixes, plurals, phrases, words in the middle of others, vector hits."""

import random

import pytest
from tessera.operators.inverted import SearchIndex, with_vector_hits
from tessera.storage import new_path


def words(text):
    return [w for w in (text or "").lower().split() if len(w) > 1]


def slow(rows, queries, k):
    out = {}
    held = {key: " " + " ".join(words(t)) + " " for key, t in rows if words(t)}
    for q, text in queries:
        w = words(text)
        first = list(dict.fromkeys(w))[:10]
        terms = set(first) | {x[:-1] for x in first if x.endswith("s") and len(x) > 3} | {x[:-3] + "y" for x in first if x.endswith("ies") and len(x) > 4}
        phrase = " " + " ".join(w[:4]) + " "
        for before in (" ", ""):
            found = {}
            for key, t in held.items():
                score = sum(max(1, len(x) / 4) for x in terms if before + x in t)
                if score:
                    found[key] = score + (8 if len(w) >= 4 and phrase in t else 0)
            if found:
                break
        best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(q, r): x for r, x in enumerate(best, 1)}
    return out


def found(df):
    return {(r["q"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 10)])
def test_same_as_scanning_all_rows(spark, seed, k):
    rng = random.Random(seed)
    letters = ["ka", "lo", "mi", "tus", "ries", "zen", "pra"]
    pool = ["".join(rng.choices(letters, k=rng.randrange(1, 4))) for _ in range(120)]
    hot = ["hottest", "common"]  # in a third of all rows
    rows = [(n, " ".join(rng.choices(pool, k=rng.randrange(1, 30)) + (hot if n % 3 == 0 else []))) for n in range(400)]
    rows += [(900, None), (901, ""), (902, "! a"), (903, "longest " * 5000), (904, rows[5][1]), (905, rows[5][1])]
    queries = [(n, " ".join(rng.choices(pool, k=rng.randrange(1, 12)) + rng.choices(hot, k=2))) for n in range(30)]
    queries += [(40, rows[5][1]), (41, ""), (42, None), (43, "hottest"), (44, "ommo ttes"), (45, "xylophone"), (46, "longes"), (47, "hotties common common common")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS bucket", "text AS token", "1 AS rows")
    ix = SearchIndex(spark, new_path(spark, "ix")).build(docs)
    got = found(ix.search(spark.createDataFrame(queries, "q long, text string").selectExpr("*", "1 AS score"), "q", k))
    assert got == slow(rows, queries, k)


def test_common_lists_are_passed_over(spark):
    """Rows that hold only a query's common word are no candidates once rarer words give k rows."""
    rows = [(n, "common" + (" extraordinary" if n < 5 else "")) for n in range(300)]
    ix = SearchIndex(spark, new_path(spark, "ix")).build(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "common extraordinary")], "q long, text string")
    tokens, lists = ix.expand(ix.terms(asked, "q"), "q")
    assert {r["doc_id"] for r in ix.candidates(lists, tokens, "q", 5).collect()} == set(range(5))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word")], "q long, text string")
    assert SearchIndex(spark, new_path(spark, "ix")).build(none).search(asked, "q", 3).count() == 0
    ix = SearchIndex(spark, new_path(spark, "ix")).build(spark.createDataFrame([(1, "word")], "doc_id long, text string"))
    assert ix.search(asked.limit(0), "q", 3).count() == 0


def test_vectors_fill_up_what_words_leave(spark):
    lexical = spark.createDataFrame([(1, 1, 7, 2.0), (2, 1, 8, 3.0), (2, 2, 7, 1.0)], "q_id long, rank int, doc_id long, score double")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "q_id long, q array<double>")
    held = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 1.0]), (9, [0.0, 1.0]), (1, [3.0, 0.0]), (5, [-1.0, 0.0]), (6, [0.0, 0.0])], "doc_id long, v array<double>")
    got = with_vector_hits(lexical, asked, held, "q_id", "doc_id", 2)
    assert sorted((r["q_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == [(1, 1, 7, 2.0), (1, 2, 1, 0.7), (2, 1, 8, 3.0), (2, 2, 7, 1.0), (3, 1, 9, 0.7), (3, 2, 8, 0.494975)]


def test_whole_passages_are_looked_up(spark, tmp_path):
    """A row that holds a passage's last words only is found, and a phrase is the whole passage; as in the SQL."""
    import __spark_entry__ as entry
    import duckdb

    pool = [a + b for a in ("ka", "lomi", "tusen") for b in ("ro", "venk", "straiteln", "mopras")]
    passage = " ".join(pool)
    docs = [(1, " ".join(pool[:4])), (2, " ".join(pool[10:])), (3, "nothing"), (4, passage), (5, " ".join(pool[::-1])), (6, "x " + passage + "!"), (7, None), (8, "tusenmopra"), (9, pool[3])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = [(1, passage), (2, None), (3, pool[3]), (4, "the of"), (5, "usenmop"), (6, "nothing again")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()["indexed_search"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(entry.oracle_sql()["indexed_search"]).fetchall())
    first = {d: s for q, _, d, s in got if q == 1}
    assert first[2] > 1 and first[4] == first[6] == first[5] + 2 * len(pool) and 9 in first and 3 not in first
