"""Numeric and order-dependent operators: invariants, round trips, plain loops."""

import itertools
import json
import re
import zipfile
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import blocks as B
from tessera.operators import graph as graphs
from tessera.operators import relational as R
from tessera.operators import search as S
from tessera.sources import files
from tessera.streaming import events

FLOATS = st.lists(st.floats(-50, 50), min_size=1, max_size=25)


@given(FLOATS)
@settings(max_examples=60, deadline=None)
def test_isotonic(y):
    y = np.array(y)
    fit = B.isotonic(y)
    assert (np.diff(fit) >= -1e-9).all() and abs(fit.sum() - y.sum()) < 1e-6
    np.testing.assert_allclose(B.isotonic(fit), fit, atol=1e-9)
    n = len(y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    np.testing.assert_allclose(fit, want, atol=1e-8)


@given(FLOATS)
@settings(max_examples=40, deadline=None)
def test_unimodal_is_no_worse_than_isotonic(y):
    y = np.array(y)
    u = B.unimodal(y)
    top = int(u.argmax())
    assert (np.diff(u[: top + 1]) >= -1e-9).all() and (np.diff(u[top:]) <= 1e-9).all()
    assert ((u - y) ** 2).sum() <= ((B.isotonic(y) - y) ** 2).sum() + 1e-9


def test_dykstra_meets_both_sets():
    y = np.array([3.0, 1.0, 2.0, -1.0])
    x = B.dykstra(y, [B.isotonic, lambda v: np.clip(v, 0, 1.5)])
    assert (np.diff(x) >= -1e-6).all() and (x >= -1e-9).all() and (x <= 1.5 + 1e-9).all()
    assert (B.trapezoid(y, np.zeros(4), np.full(4, 2.0)) == [2, 1, 2, 0]).all()


def test_lattice():
    r = np.random.default_rng(0)
    x = r.standard_normal((40, 8)) * 2
    p = B.e8_nearest(x)
    twice = np.rint(2 * p)
    assert np.allclose(2 * p, twice) and ((twice % 2 == twice[:, :1] % 2).all()) and (p.sum(1) % 2 == 0).all()
    assert np.allclose(B.e8_nearest(p), p) and (((x - p) ** 2).sum(1) <= 1 + 1e-9).all()
    near = [np.array(v) * 1.0 for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) in (0, 2) and sum(v) % 2 == 0]
    for i in range(10):
        assert min(((x[i] - p[i] - v) ** 2).sum() for v in near) >= ((x[i] - p[i]) ** 2).sum() - 1e-9


def test_quantise_and_octonions():
    r = np.random.default_rng(1)
    x = r.standard_normal((20, 64))
    codes, low, span = B.quantise(x)
    assert codes.max() <= 15 and np.abs(B.dequantise(codes, low, span) - x).max() < 0.6
    a, b = r.standard_normal((2, 30, 8))
    np.testing.assert_allclose(np.linalg.norm(B.octonion_product(a, b), axis=1), np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


@given(st.lists(st.integers(1, 300), min_size=0, max_size=40))
@settings(max_examples=60, deadline=None)
def test_packed_chunks(sizes):
    text = " ".join("w" * (n - 1) + "." for n in sizes)
    got = B.pack_chunks(text, 200, 20)
    assert all(0 < len(c) <= 200 for c in got)
    assert not text or text.startswith(got[0]) and text.endswith(got[-1])
    assert set(re.findall(r"\S", text)) == set(re.findall(r"\S", " ".join(got)))


def test_code_graph_beam_thompson():
    got = B.code_graph("import os\ndef f(x):\n    try:\n        return eval(x)\n    except:\n        pass\nclass C:\n    'doc'\n")
    assert {("import", "module", "os"), ("function", "module", "f"), ("unsafe call", "f", "eval"), ("bare except", "f", ""), ("class", "module", "C"), ("missing docstring", "module", "f")} <= set(got)
    assert B.code_graph("def (") == []
    assert B.beam([[("a", 1.0), ("b", 0.5)], [("b", 1.0), ("a", 0.2)]], 1) == [(("a", "b"), 2.0)]
    assert sorted(B.thompson([("x", 1, 0), ("y", 0, 9)], 3)) == ["x", "y"]


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    lit = F.lit
    assert val(T.normalise_text(lit("exam-\nple  of cafÃ© "))) == "example of café"
    assert val(T.normalise_text(lit(None).cast("string"))) == ""
    assert val(T.tokenize(lit("The Red-fox, a 2nd fox!"))) == ["red", "fox", "2nd", "fox"]
    assert val(T.bigrams(lit(None).cast("array<string>"))) in (None, [])
    assert val(T.normal_date(lit("15 Mar 2023"))) == "2023-03-15" and val(T.normal_date(lit("March 5, 1999"))) == "1999-03-05"
    assert val(T.normal_date(lit("around 1850"))) == "1850" and val(T.normal_date(lit("soon"))) == "soon"
    assert val(T.redact(lit("call +44 20 7946 0958 or a@b.org, 4111 1111 1111 1111, 123-45-6789"))) == "call [PHONE] or [EMAIL], [CARD], [SSN]"
    assert val(T.luhn(lit("79927398713"))) and not val(T.luhn(lit("79927398714"))) and not val(T.luhn(lit("")))
    assert val(T.keyword_variants(lit("Cities"))) == ["Cities", "citie", "cities", "city"]
    assert val(T.stage(lit("Why? Compare these"))).stage == "logic" and val(T.stage(lit(None).cast("string"))).share == 0.0
    assert val(T.intent(lit("What is the difference"))) == "comparative"
    assert tuple(val(T.triple(lit("The cat is a mammal")))) == ("cat", "is_a", "mammal") and val(T.triple(lit("nothing"))) is None
    assert val(T.strip_thinking(lit("<think>hm</think> yes"))) == "yes"
    assert val(T.windows(lit("x" * 4000))) == ["x" * 2000, "x" * 2000, "x" * 400]


def test_geometry(spark):
    r = np.random.default_rng(2)
    pts = [(i, *(0.4 * r.standard_normal((2, 5)) / 2).tolist()) for i in range(20)]
    df = spark.createDataFrame(pts, "id long, a array<double>, b array<double>")
    got = df.select(
        G.distance(F.col("a"), F.col("b")).alias("ab"), G.distance(F.col("b"), F.col("a")).alias("ba"), G.distance(F.col("a"), F.col("a")).alias("aa"),
        G.norm(F.zip_with(G.log0(G.exp0(F.col("a"))), F.col("a"), lambda x, y: x - y)).alias("back"),
        G.norm(F.zip_with(G.from_klein(G.to_klein(F.col("a"))), F.col("a"), lambda x, y: x - y)).alias("klein"),
        G.norm(G.mobius_add(F.transform("a", lambda x: -x), F.col("a"))).alias("zero"),
    ).collect()
    for g in got:
        assert abs(g.ab - g.ba) < 1e-9 and g.aa < 1e-6 and g.back < 1e-9 and g.klein < 1e-9 and g.zero < 1e-9


def test_graph_operators(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (5, 6, 1), (6, 7, 2), (3, 3, 1)], "src long, dst long, weight long")
    ids = spark.createDataFrame([(k,) for k in range(1, 9)], "node long")
    assert {r.node: r.component for r in graphs.components(ids, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}
    p = graphs.shortest_paths(e, ids.where("node = 1"), ids.where("node IN (3, 7)"), 4).collect()
    assert [(r.start, r.end, r.path) for r in p] == [(1, 3, [1, 2, 3])]
    assert {(r.node, r.hops) for r in graphs.expand(e, ids.where("node = 5"), 1).collect()} == {(5, 0), (6, 1)}
    assert abs(graphs.pagerank(e, 5).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert {(r.src, r.dst) for r in graphs.closure(e.where("src != dst"), [], 5).collect()} == {(1, 2), (2, 3), (1, 3), (5, 6), (6, 7), (5, 7)}


def test_relational_and_metrics(spark):
    d = spark.createDataFrame([("x", 0.1, 0), ("x", 0.7, 1), ("y", 0.2, 2)], "k string, score double, pos long")
    assert {tuple(r) for r in R.best_duplicate(d, ["k"], "score", "pos").collect()} == {("x", 0.7, 0), ("y", 0.2, 2)}
    assert {tuple(r) for r in R.keep_first(d, ["k"], "pos").collect()} == {("x", 0.1, 0), ("y", 0.2, 2)}
    up = R.merge_latest(d, spark.createDataFrame([("y", 0.9, 5)], d.schema), "k", "pos")
    assert {tuple(r) for r in up.collect()} == {("x", 0.7, 1), ("y", 0.9, 5)}
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, item string, rank int")
    m = S.retrieval_metrics(ranked, spark.createDataFrame([("q", "b")], "query string, item string"), 5).first()
    assert (m.recall, m.precision, m.mrr) == (1.0, 0.2, 0.5)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Note\n---\n# Head\ntext\n```py\nx = 1\n```\n")
    (tmp_path / "b.html").write_text("<html><title>Page</title><script>no</script><h1>Top</h1><p>Body <a href='u'>link</a></p></html>")
    (tmp_path / "c.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Book\n", "hi"]}, {"cell_type": "code", "source": ["1+1"]}]}))
    (tmp_path / "d.bin").write_bytes(b"\x00")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "e.txt").write_text("hidden")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", "<w:d xmlns:w='w'><w:p><w:t>Hello</w:t></w:p></w:d>")
    (tmp_path / "g.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_texts(files.scan_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.md", "b.html", "c.ipynb", "f.docx", "g.docx"}
    assert got["a.md"].title == "Note" and "[H1] Head" in got["a.md"].text and "[CODE]" in got["a.md"].text
    assert got["b.html"].title == "Page" and "no" not in got["b.html"].text.split() and "[H1] Top" in got["b.html"].text
    assert got["c.ipynb"].title == "Book" and got["f.docx"].text == "Hello" and got["g.docx"].text == ""
    t = spark.createDataFrame([("Paris",), ("Rome",), ("Paris",)], "term string")
    files.write_gazetteer(t, "term", str(tmp_path / "gaz"))
    assert {r.term for r in files.gazetteer(spark, str(tmp_path / "gaz")).collect()} == {"Paris", "Rome"}
    files.write_facts(t, str(tmp_path / "facts"))
    assert files.read_facts(spark, str(tmp_path / "facts"), "term string").count() == 3
    assert files.report(t, "Terms", "term", "term").count("- Paris") == 2


def test_stream_over_files(spark, tmp_path):
    e = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 10), 7, "a", 1.0), (2, datetime(2024, 1, 1, 0, 50), 7, "a", 3.0), (3, datetime(2024, 1, 1, 2), 8, "b", 5.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    for k in (1, 2, 3):
        e.where(f"event_id = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: events.source(spark, str(tmp_path / "in"), e, files=1)
    out = events.drain(events.decayed_state(stream()), "t", "update").groupBy("user_id").agg(F.max_by(F.struct("n", "x"), "n").alias("s")).collect()
    assert {r.user_id: r.s.n for r in out} == {7: 2, 8: 1} and {r.user_id: r.s.x for r in out}[8] == 5.0
    assert events.refresh_centroids(e, {"a": 10.0}) == {"a": 0.9 * 10 + 0.1 * 2.0, "b": 5.0}


def test_sql_functions(spark):
    from tessera.registration import register

    register(spark)
    assert spark.sql("SELECT chunk FROM text_chunks('one. two.', 2000, 200)").first()["chunk"] == "one. two."
    assert {r.kind for r in spark.sql("SELECT * FROM code_graph('import os')").collect()} == {"import"}
    assert spark.sql("SELECT isotonic(array(3D, 1D)) AS x").first()["x"] == [2.0, 2.0]


def test_blocked_distances_and_opposed_facts(spark):
    from tessera.operators import vectors
    from tessera.plans.common import opposed

    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, (rng.standard_normal(4) * 0.2).tolist()) for i in range(60)], "vec_id long, p array<double>")
    q = p.where("vec_id % 3 = 0").select(p.vec_id.alias("query_id"), p.p.alias("q"))
    near = lambda block: {tuple(r) for r in vectors.neighbours(q, p, 5, block).select("query_id", "vec_id", "rank").collect()}
    assert near(4) == near(2000)
    assert vectors.distances(q.limit(0), p).count() == 0
    f = [(1, 0, "x", True, 0.5), (2, 0, "x", False, 0.1), (3, 0, "x", False, 0.9), (4, 0, "y", True, 0.2), (5, 1, "x", True, 0.2)]
    got = opposed(spark.createDataFrame(f, "fact_id long, fact_type int, canonical_value string, negation boolean, confidence double"))
    assert {tuple(r) for r in got.select("fact_id", "links", "first", "strongest").collect()} == {(1, 2, 2, 3), (2, 1, 1, 1), (3, 1, 1, 1)}


def test_collective_links_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(1, f"m{m}", int(c), float(rng.integers(0, 4)) / 10, str(rng.integers(0, 2))) for m in range(4) for c in range(2)]
    got = B.link_mentions(spark.createDataFrame(rows, "doc_id long, mention string, candidate long, score double, group string"), swaps=50)
    pick = {r["mention"]: r["candidate"] for r in got.collect()}
    by = {(m, c): (s, g) for _, m, c, s, g in rows}

    def worth(p):
        chosen = [by[m, c] for m, c in p.items()]
        return sum(s for s, _ in chosen) + 0.1 * sum(a[1] == b[1] for i, a in enumerate(chosen) for b in chosen[:i])

    # no single swap is better
    assert all(worth(pick | {m: c}) <= worth(pick) + 1e-9 for m, c in by)


def test_pruned_neighbours_are_exact(spark):
    from tessera.operators import vectors

    rng = np.random.default_rng(9)
    centres = rng.standard_normal((5, 4)) * 0.3
    x = [(centres[i % 5] + rng.standard_normal(4) * 0.05) for i in range(120)] + [centres[0]] * 4
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, p array<double>")
    q = p.where("vec_id % 4 = 0").select(p.vec_id.alias("query_id"), p.p.alias("q"))
    rows = lambda df: {(r["query_id"], r["rank"]): round(r["d"], 6) for r in df.collect()}
    want = rows(vectors.neighbours(q, p, 6))
    assert rows(vectors.pruned_neighbours(q, p, 6, pivots=5)) == want
    assert rows(vectors.pruned_neighbours(q, p, 6, pivots=40)) == want
    assert vectors.pruned_neighbours(q, p.limit(0), 6).count() == 0


def test_first_json(spark):
    cases = {'<think>{"a": 0}</think> {"a": 1,}': '{"a": 1}', "none": "", "x [1, 2, ] y": "[1, 2 ]", "“a” {“a”: 2}": '{"a": 2}'}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["j"] for r in df.select("t", T.first_json(F.col("t")).alias("j")).collect()} == cases


def test_centroid_stream_over_two_batches(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame([(k, v, datetime(2024, 1, 1)) for k, v in rows], "k string, v double, ts timestamp").coalesce(1).write.parquet(str(tmp_path / name))

    put("a", [("x", 1.0), ("x", 3.0), ("y", 5.0)])
    like = spark.read.parquet(str(tmp_path / "a"))
    got = lambda: {r["k"]: round(r["centroid"], 9) for r in events.centroids(events.source(spark, str(tmp_path / "*"), like, files=1), "k", "v").collect()}
    assert got() == {"x": 2.0, "y": 5.0}
    put("b", [("x", 4.0), ("z", 7.0)])
    assert got() == {"x": round(0.9 * 2 + 0.1 * 4, 9), "y": 5.0, "z": 7.0}
