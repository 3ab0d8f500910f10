"""Sentences with places and grounded spans against plain dynamic programming."""

import random

from tessera.functions.sentences import fuzzy_place, ground, least_edits, sentence_spans
from tessera.operators.grounding import grounded, sentences

TEXT = "Dr. Holt met J. K. Moss at 3.5 p.m. on Feb. 3. They spoke (at length.) It cost 4.90! See No. 7 and pp. 4-5. Was it I. Then?  \n“Yes.” Fin"


def split(t):
    return [t[a:b] for a, b in sentence_spans(t)]


def test_sentences_go_on_after_abbreviations_initials_and_decimals():
    assert split(TEXT) == ["Dr. Holt met J. K. Moss at 3.5 p.m. on Feb. 3.", "They spoke (at length.)", "It cost 4.90!", "See No. 7 and pp. 4-5.", "Was it I.", "Then?", "“Yes.”", "Fin"]
    assert split(None) == split("") == split(" \n") == [] and split("No end") == ["No end"] and split("Wait... what?!  Yes") == ["Wait...", "what?!", "Yes"]


def test_places_hold_all_text():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice(["Dr. ", "a", "B.", ". ", "! ", "é", "😀", "3.5", "\n", " ", "? ", "No. 4 ", ".)"]) for _ in range(rng.randint(0, 40)))
        spans = sentence_spans(t)
        assert all(t[a:b] == t[a:b].strip() != "" for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())


def slow_edits(p, t):
    row = list(range(len(p) + 1))
    best, end = row[-1], 0
    for j, c in enumerate(t):
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] < best:
            best, end = row[-1], j + 1
    return best, end


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_fuzzy_places_against_all_places():
    rng = random.Random(2)
    for _ in range(600):
        p = "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 14)))
        t = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.6:
            k = rng.randrange(len(p))
            t += p[:k] + rng.choice("abx") + p[k + 1 :] + t[:9]
        assert least_edits(p, t) == slow_edits(p, t)
        most = rng.randint(0, 3)
        best = min((distance(p, t[a:b]) for a in range(len(t) + 1) for b in range(a, len(t) + 1)), default=len(p))
        got = fuzzy_place(p, t, most)
        if best > most or best == len(p):
            assert got is None or got[2] == best
        else:
            assert got and got[2] == best == distance(p, t[got[0] : got[1]])


def test_ground():
    t = "The river rises in spring. Boats wait until May. Nobody minds."
    assert ground(t, "Boats wait", "x", 27, 37) == (True, 27, 37, "exact at offsets")
    assert ground(t, "Boats wait", "x", 1, 5) == (True, 27, 37, "exact") == ground(t, " Boats wait ", None)
    assert ground(t, "boats wai1t", "x") == (True, 28, 37, "fuzzy") or ground(t, "boats wai1t", "x")[3] == "fuzzy"
    assert ground(t, "something else altogether", "x", 4, 9) == (True, 4, 9, "offsets")
    assert ground(t, "something else altogether", "nobody minds. at all") == (False, None, None, "not found")
    assert ground(t, "something else altogether", "Nobody minds") == (False, 49, 62, "nearest sentence")
    assert ground(None, None, None) == (False, None, None, "not found") == ground("", "x", "y", 0, 4)


def test_operators(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "One. Two.")], "doc_id long, text string")
    got = sentences(docs).collect()
    assert all(r.sentence == {1: TEXT, 3: "One. Two."}[r.doc_id][r.start : r.end] for r in got) and len(got) == 10
    facts = spark.createDataFrame([(7, TEXT, "Holt met", "Dr. Holt met", None, None), (8, None, None, None, 1, 2)], "fact_id long, text string, span string, fact_text string, start int, end int")
    assert {(r.fact_id, r.valid, r.start, r.reason) for r in grounded(facts).collect()} == {(7, True, 4, "exact"), (8, False, None, "not found")}


def test_results_are_made_a_few_rows_at_a_time(spark):
    """A large batch's sentences and chunks never stand in Python's lists at once."""
    import pyarrow as pa
    from tessera.operators import blocks, grounding

    batch = pa.RecordBatch.from_pydict({"k": list(range(1000))})
    parts = list(grounding.slices(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= grounding.ROWS < 1000 and [k for p in parts for k in p.column(0).to_pylist()] == list(range(1000))
    texts = [None, "", "One is here. Two is there! " * 9] + [f"Number {n} says so. " * (n % 30) for n in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [(d, p, a, z) for d, t in enumerate(texts) for p, (a, z) in enumerate(sentence_spans(t))]
    assert sorted((r.doc_id, r.pos, r.start, r.end) for r in sentences(docs).collect()) == want
    got = blocks.chunks(docs, 100, 10)
    assert sorted(map(tuple, got.collect())) == [(d, k, c) for d, t in enumerate(texts) for k, c in enumerate(blocks.pack_chunks(" ".join((t or "").split()), 100, 10))]
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
