"""Rule annotation: 13 buckets with places, on a made-up article and against plain Python."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import annotate as A

ARTICLE = """by Anna Berg
OSLO, Norway — Talks went on.
LENA: Good day to all.
[00:12:33] Dr. Holt: And to you.
Printed 1999-11-30 and 24.12.2001, see p. 17, pp. 20-24 and Pages 3.
ISBN 978-3-16-148410-0, ISSN 0317-8471, doi 10.5555/12345678.
As in Moore & Hill (1987a) and Thshea Stteä, June 2011, circa 1780, 1914–1918, Feb 3, 1950.
Part IV
The Harbour Trust University was founded by Peter Quill in Bergen. Nobody came.
"""


def test_article(spark):
    a = spark.createDataFrame([(ARTICLE,), (None,)], "text string").select(A.annotations(F.col("text")).alias("a")).collect()
    got = {k: [m.text for m in v] for k, v in a[0].a.items()}
    counts = spark.createDataFrame([(ARTICLE,)], "text string").select(*(A.mention_count(F.col("text"), b).alias(b) for b in A.PLAIN)).first().asDict()
    assert counts == {b: len(got[b]) for b in A.PLAIN}
    assert got["years"] == ["1999", "2001", "2011", "1780", "1914", "1918", "1950"]
    assert sorted(got["dates"]) == sorted(["1999-11-30", "24.12.2001", "June 2011", "circa 1780", "1914–1918", "Feb 3, 1950"])
    assert got["pages"] == ["p. 17", "pp. 20-24", "Pages 3"]
    assert got["identifiers"] == ["ISBN 978-3-16-148410-0", "ISSN 0317-8471", "10.5555/12345678"]
    assert got["bylines"] == ["Anna Berg"] and got["datelines"] == ["OSLO, Norway"] and got["speakers"] == ["LENA", "Dr. Holt"]
    assert got["citations"] == ["Moore & Hill (1987a)"] and got["chapters"] == ["Part IV"]
    assert "Anna Berg" in got["people"] and "Peter Quill" in got["people"] and not any("Stte" in p for p in got["people"])
    assert got["organizations"] == ["The Harbour Trust University"] and [e.split("\n")[-1] for e in got["events"]] == ["The Harbour Trust University was founded by Peter Quill in Bergen."]
    assert all(ARTICLE[m.start : m.end] == m.text for v in a[0].a.values() for m in v)
    assert set(got) | {"locations"} == set(A.BUCKETS) and all(v == [] for v in a[1].a.values())


LINES = {
    "bylines": [("Story by Li Wei", ["Li Wei"]), ("Authors: A. B. Moss", ["A. B. Moss"]), ("by the river", []), ("By Ann and others went home", []), ("writer: Élodie Roux", ["Élodie Roux"])],
    "datelines": [("NEW YORK — It rained.", ["NEW YORK"]), ("PARIS, France -- It rained.", ["PARIS, France"]), ("Paris — it rained", []), ("BONN: quiet", []), ("ÅLESUND – Fisk.", ["ÅLESUND"])],
    "speakers": [("Speaker 2: well", ["Speaker 2"]), ("[1:02] Mr. O'Neil: yes", ["Mr. O'Neil"]), ("note: no", []), ("Anna:", []), ("One Two Three Four Five Six: no", [])],
    "chapters": [("Chapter 12", ["Chapter 12"]), ("APPENDIX B: Tables", ["APPENDIX B: Tables"]), ("section 3.1 - On rain", ["section 3.1 - On rain"]), ("part of it", []), ("Act of grace", [])],
    "citations": [("so Berg, Holt and Weiss-Moore (1999) say", ["Berg, Holt and Weiss-Moore (1999)"]), ("Quill et al. (2004b)", ["Quill et al. (2004b)"]), ("in Oslo (12)", [])],
    "identifiers": [("ISBN 0-306-40615-2", ["ISBN 0-306-40615-2"]), ("ISBN: 9780306406157", ["ISBN: 9780306406157"]), ("ISBN 12345", []), ("see 10.1000/xyz-1.", ["10.1000/xyz-1"]), ("ISSN 2049-363X", ["ISSN 2049-363X"])],
    "pages": [("p. 9", ["p. 9"]), ("pages 10–12", ["pages 10–12"]), ("pp 9", []), ("page", [])],
    "events": [("It was signed here. Nothing else.", ["It was signed here."]), ("Signedness", [])],
    "organizations": [("the Sea Bank of old", ["the Sea Bank"]), ("banking", [])],
}


def test_single_lines(spark):
    """Literal expectations, bucket by bucket."""
    cases = [(b, t, want) for b, v in LINES.items() for t, want in v]
    df = spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(cases)], "n long, text string").select("n", A.annotations(F.col("text")).alias("a"))
    for r in df.collect():
        bucket, text, want = cases[r.n]
        assert [m.text for m in r.a[bucket]] == want, (bucket, text)


def test_first_names_gate_people(spark):
    df = spark.createDataFrame([("Anna Berg met Tall Tree",)], "text string")
    assert [m.text for m in df.select(A.annotations(F.col("text"), ("anna",))["people"].alias("p")).first().p] == ["Anna Berg"]


def test_places_against_plain_python(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["1914", "é", "😀", " ", "-", "2020-01-15", "Jan 2001", "x", "\n", "p. 4"]) for _ in range(r.randint(0, 40))) for _ in range(200)] + ["1914 x 2001\n" * 700]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", A.places(F.col("text"), A.word(A.YEAR)).alias("y")).collect()
    for row in rows:
        want = [(m[0], m.start(), m.end()) for m in re.finditer(rf"(?<!\w){A.YEAR}(?!\w)", row.text)]
        assert [tuple(m) for m in row.y] == want


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "Near New  York, not Newark; in Ulm."), (2, None), (3, "ULM and ulms")], "doc_id long, text string")
    terms = spark.createDataFrame([("New York", "city"), ("Ulm", "city"), ("York", "county"), ("Mars", "city")], "term string, kind string")
    got = sorted(tuple(x) for x in A.gazetteer_mentions(docs, terms).collect())
    assert got == [(1, "New York", "city", 5, 14), (1, "Ulm", "city", 31, 34), (1, "York", "county", 10, 14), (3, "Ulm", "city", 0, 3)]


def test_gazetteer_counts_are_its_mentions(spark):
    """Counts without places equal the mentions, and need no arrays of places."""
    texts = ["New York, new  york! York", None, "", "a b a b a", "Éa b; É A B", "york"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([("New York", "place"), ("York", "place"), ("a b a", "x"), ("a B", "x"), ("éa b", "y"), ("none", "y")], "term string, kind string")
    got = A.gazetteer_counts(docs, terms, most=3)
    want = A.gazetteer_mentions(docs, terms, most=3).groupBy("doc_id", "term", "kind").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 7
    assert "start" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_whole_matches_are_searched_once(spark):
    df = spark.createDataFrame([("on page 3 and 4",)], "t string")
    for group, times in ((0, 1), (1, 2)):
        out = df.select(A.places(F.col("t"), "([0-9])", group).alias("p"))
        assert [(m.text, m.start, m.end) for m in out.first().p] == [("3", 8, 9), ("4", 14, 15)]
        assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == times
