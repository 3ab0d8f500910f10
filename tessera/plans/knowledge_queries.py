"""Communities by modularity, contradictions by meaning, fuzzy names, ball trees, layered embeddings, a trained gate, shapes and far points."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators.ball_tree import build, search
from ..operators.canonical import LEAST, MOST, canonical_names
from ..operators.embeddings import layered, seeded_features, seeded_weights
from ..operators.gate import train as train_gate
from ..operators.grounding import grounded, sentences
from ..operators.lattice import route_cells
from ..operators.modularity import modularity, modularity_communities
from ..operators.provenance import Ledger, compared, table_digest
from ..operators.shapes import dominance, edgeworth, far_points
from ..operators.term_scores import rounded
from ..operators.threshold_join import met_counts, pairs_of, strongest_of
from ..operators.vector_index import VectorIndex
from ..operators.vectors import ball_distances
from ..storage import new_path, settle
from ..streaming.expiring import SESSION, ActiveNames
from ..streaming.expiring import run as run_states
from .audit_queries import CONTRA_SQL, contradiction_pairs
from .common import EDGES_SQL, FACTS_SQL, STOP_SQL, TOKENS_SQL, edges, facts, points, tokens
from .registry import load, query
from .stream_queries import stream
from .vector_queries import KNN_SQL


@query()
def keyword_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of all suppliers and parts, merged for modularity."""
    return modularity_communities(edges(spark, sf))


@query(f"""WITH {EDGES_SQL}, l AS (SELECT src AS node, src % 5 AS c FROM edges UNION SELECT dst, dst % 5 FROM edges), t AS (SELECT sum(weight)::DOUBLE AS m FROM edges),
i AS (SELECT coalesce(sum(weight), 0)::DOUBLE AS w FROM edges WHERE src % 5 = dst % 5), k AS (SELECT node % 5 AS c, sum(weight)::DOUBLE AS k FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY ALL)
SELECT 'key remainder' AS partition, round((SELECT w FROM i) / m - (SELECT sum(k * k) FROM k) / (4 * m * m), 9) AS modularity FROM t""")
def partition_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Modularity of a stated partition of suppliers and parts: by the remainder of their keys."""
    e = edges(spark, sf)
    labels = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node") % 5)
    return spark.createDataFrame([("key remainder", round(modularity(e, labels), 9))], "partition string, modularity double")


#: Dimensions of a document's vector of hashed words, and the cosine from which two of them say the same.
HASHED, ALIKE = 256, 0.85
#: Texts whose words a task counts at once.
TEXTS = 1024
VECTORS_SQL = f"""terms AS (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {HASHED} AS dim, count(*)::DOUBLE AS n FROM (
    SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS w FROM documents) WHERE length(w) > 1 AND w NOT IN {STOP_SQL} GROUP BY ALL
), norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM terms GROUP BY doc_id
), meaning AS (
  SELECT f.doc_id AS fact_id, s.doc_id AS standard_id, sum(f.n * s.n) / any_value(a.norm) / any_value(b.norm) AS cosine
  FROM terms f JOIN terms s ON f.dim = s.dim AND f.doc_id % 10 <> 0 AND s.doc_id % 10 = 0 AND (f.doc_id % 7 = 0) <> (s.doc_id % 7 = 0)
  JOIN norms a ON a.doc_id = f.doc_id JOIN norms b ON b.doc_id = s.doc_id GROUP BY ALL HAVING cosine > {ALIKE})"""


def hashed_vectors(words: DataFrame, dims: int = HASHED) -> DataFrame:
    """(id, v): how often each document's words (doc_id, token) fall into each of `dims` hashed places."""
    dim = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % dims
    counts = words.groupBy("doc_id", dim.alias("dim")).agg(F.count("*").cast("double").alias("n"))
    found = counts.groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("dim", "n"))).alias("m"))
    return found.select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda k: F.coalesce(F.get(F.array(F.col("m")[k]), F.lit(0)), F.lit(0.0))).alias("v"))


def counted_vectors(docs: DataFrame, dims: int = HASHED) -> DataFrame:
    """(id, v): as `hashed_vectors`, in whole numbers, of documents (doc_id, text). Tasks hash each different word of some texts once, and no words are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                words = b.column(1).flatten().dictionary_encode()
                dim = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % dims for w in words.dictionary.to_pylist()], np.int64)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy())
                n = np.bincount(row * dims + dim[words.indices.to_numpy()], minlength=b.num_rows * dims).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) + 1, dims), pa.int32()), pa.array(n))], ["id", "v"])

    given = docs.select(F.col("doc_id").cast("long").alias("id"), T.tokenize(F.col("text")).alias("w")).where(F.size("w") > 0)
    v = settle(given.mapInArrow(run, "id long, v array<int>"), "counted-vectors")
    twice = settle(v.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "ids-twice")
    if twice.isEmpty():
        return v
    none = F.array_repeat(F.lit(0), dims)
    summed = v.join(twice, "id", "left_semi").groupBy("id").agg(F.aggregate(F.collect_list("v"), none, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)).alias("v"))
    return settle(v.join(twice, "id", "left_anti").unionAll(summed), "counted-vectors")


def opposed_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(cell, id, v) of facts and of standards: what is denied lies in a cell with what is stated and the other way round, so only opposed pairs meet."""
    v = counted_vectors(load(spark, sf, "documents"))
    denied, standard = F.col("id") % 7 == 0, F.col("id") % 10 == 0
    return v.where(~standard).select(denied.cast("int").alias("cell"), "id", "v"), v.where(standard).select((~denied).cast("int").alias("cell"), "id", "v")


@query(f"WITH {VECTORS_SQL} SELECT fact_id, standard_id, round(cosine, 6) AS similarity, 'high similarity with opposite negation' AS reason FROM meaning")
def semantic_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against the standards among them (ids divisible by 10): alike in meaning, opposed in negation."""
    both = met_counts(*opposed_vectors(spark, sf), ALIKE, pairs_of, "fact_id long, standard_id long, similarity double", rounded)
    return both.withColumn("reason", F.lit("high similarity with opposite negation"))


@query(f"""WITH {CONTRA_SQL}, {VECTORS_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY fact_id) AS links, row_number() OVER (PARTITION BY fact_id ORDER BY round(cosine, 6) DESC, standard_id) AS r FROM meaning)
SELECT kind, a, b, links FROM c UNION ALL SELECT 'meaning', fact_id, standard_id, links FROM m WHERE r = 1""")
def all_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with their strongest opponent, and how many there are: by negation and text (sentences), and by meaning (documents and standards)."""
    # each block's strongest and count are taken where its pairs are found: there are as many pairs as facts times standards
    each = met_counts(*opposed_vectors(spark, sf), ALIKE, strongest_of, "fact_id long, standard_id long, similarity double, n long", rounded)
    m = each.groupBy(F.col("fact_id").alias("a")).agg(F.min_by("standard_id", F.struct(-F.col("similarity"), "standard_id")).alias("b"), F.sum("n").alias("links"))
    return contradiction_pairs(spark, sf).unionByName(m.select(F.lit("meaning").alias("kind"), "a", "b", "links"))


NAME_WORDS = 8


def name_words(text: Column) -> Column:
    """The distinct words of a name, sorted: its first NAME_WORDS words of ASCII letters and digits, lower-cased."""
    return F.array_sort(F.array_distinct(F.slice(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)")), 1, NAME_WORDS)))


@query(f"""WITH RECURSIVE w AS (SELECT doc_id AS id, lang AS kind, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')[1:{NAME_WORDS}])) AS s FROM documents),
d AS (SELECT kind, s, min(id) AS rep FROM w WHERE len(s) > 0 GROUP BY ALL),
p AS (SELECT a.kind, a.rep AS a, b.rep AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS x, len(b.s) AS y FROM d a JOIN d b ON a.kind IS NOT DISTINCT FROM b.kind AND a.rep < b.rep),
q AS (SELECT kind, a, b, i / (x + y - i)::DOUBLE AS sim FROM p WHERE i / (x + y - i)::DOUBLE >= {LEAST}),
t AS (SELECT kind, greatest({LEAST}, least({MOST}, median(sim))) AS threshold FROM q GROUP BY kind),
e AS (SELECT a, b FROM q JOIN t ON q.kind IS NOT DISTINCT FROM t.kind WHERE sim >= threshold),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT rep AS node, rep AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS canonical FROM r GROUP BY node)
SELECT w.id, w.kind, coalesce(c.canonical, w.id) AS canonical FROM w LEFT JOIN d ON w.kind IS NOT DISTINCT FROM d.kind AND w.s = d.s LEFT JOIN c ON c.node = d.rep""")
def fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the words that they begin with: one node for names of a language that are alike."""
    names = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), name_words(F.col("text")).alias("words"))
    return canonical_names(names.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))), longest=NAME_WORDS)


@query(f"WITH {KNN_SQL} SELECT query_id, rank, round(d, 3) AS d FROM near")
def ball_tree_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest points of the rows whose id is divisible by 20, down a ball tree."""
    p = settle(points(spark, sf), "ball-input")
    q = p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("p").alias("q"))
    return search(build(p), q, 10).select("query_id", "rank", F.round("d", 3).alias("d"))


DIMS, HIDDEN, OUT = 4, 4, 3
LAYERS = [seeded_weights(HIDDEN, 2 * DIMS, 5), seeded_weights(OUT, 2 * HIDDEN, 8)]


def _layers_sql() -> str:
    """The two layers on lists."""
    sql = f"""{EDGES_SQL}, b AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
    x0 AS (SELECT node, [{', '.join(f'((node * {k + 3} * 7919 + {k * 104729}) % 1000) / 500.0::DOUBLE - 1' for k in range(DIMS))}] AS x FROM (SELECT DISTINCT a AS node FROM b))"""
    for n, weights in enumerate(LAYERS):
        dims = len(weights[0]) // 2
        value = lambda row: " + ".join(f"({w!r}::DOUBLE) * {'x' if c < dims else 'm'}[{c % dims + 1}]" for c, w in enumerate(row))  # noqa: B023, E731
        rows = ", ".join(f"greatest(0, {value(r)})" if n == 0 else value(r) for r in weights)
        sql += f""", m{n} AS (SELECT b.a AS node, [{', '.join(f'avg(x[{k + 1}])' for k in range(dims))}] AS m FROM b JOIN x{n} ON x{n}.node = b.b GROUP BY b.a),
        x{n + 1} AS (SELECT x{n}.node, [{rows}] AS x FROM x{n} JOIN m{n} USING (node))"""
    length = f"sqrt({' + '.join(f'x[{k + 1}] * x[{k + 1}]' for k in range(OUT))})"
    return f"WITH {sql} SELECT node, {', '.join(f'round(CASE WHEN {length} > 0 THEN x[{k + 1}] / {length} ELSE 0 END, 6) AS x{k}' for k in range(OUT))} FROM x2"


@query(_layers_sql())
def layered_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts by two layers of message passing over seeded features."""
    e = edges(spark, sf)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    x = layered(e, seeded_features(nodes, DIMS), LAYERS)
    return x.select("node", *(F.round(F.get("x", F.lit(k)), 6).alias(f"x{k}") for k in range(OUT)))


MARKS = ".,;:!?#*$%&|<>"


def gate_features(text: Column) -> list[Column]:
    """22 statistics of a text: shares of kinds of characters, and its words."""
    size, words = F.greatest(F.char_length(text), F.lit(1)), F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    shares = [share(p) for p in (r"\p{L}", r"\p{Lu}", r"\d", " ", "\n", *("[" + c + "]" for c in MARKS))]
    distinct = F.size(F.array_distinct(F.split(text, r"\s+"))) / words
    return [*shares, words / size, F.least(distinct, F.lit(1.0)), size / words / 50]


@query()
def trained_gate(spark: SparkSession, sf: str) -> DataFrame:
    """(place, weight) of a gate that tells good documents from bad ones, trained on all labelled ones; place 0 is the bias."""
    docs = load(spark, sf, "documents").select("doc_id", F.array(*gate_features(F.coalesce("text", F.lit("")))).alias("x"))
    rows = docs.join(load(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    w, _ = train_gate(rows, steps=20, rate=2.0, penalty=0.0005, extra=0.0005)
    return spark.createDataFrame([(k, round(float(x), 9)) for k, x in enumerate(w)], "place int, weight double")


@query()
def far_apart(spark: SparkSession, sf: str) -> DataFrame:
    """Ten points, each as far as can be from those before it."""
    return far_points(settle(points(spark, sf), "far-input"), 10, ball_distances).withColumn("d", F.round("d", 6))


@query()
def ordered_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """How far each nation's balances, by market segment and key, are from supermodular, and its first two segments from a steeper first one."""
    grid = load(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment", (F.col("c_custkey") % 4).alias("place")).agg((F.avg("c_acctbal") / 1000).alias("x"))

    def run(g: pd.DataFrame) -> pd.DataFrame:  # at most five segments by four places
        y = g.pivot(index="c_mktsegment", columns="place", values="x").sort_index().fillna(0.0).to_numpy()
        moved = [((edgeworth(y) - y) ** 2).sum()]
        p, q = dominance(y[0], y[-1])
        moved.append(((p - y[0]) ** 2).sum() + ((q - y[-1]) ** 2).sum())
        return pd.DataFrame({"nation": [g["c_nationkey"].iloc[0]], "edgeworth": [moved[0]], "dominance": [moved[1]]})

    out = grid.groupBy("c_nationkey").applyInPandas(run, "nation long, edgeworth double, dominance double")
    return out.select("nation", F.round("edgeworth", 6).alias("edgeworth"), F.round("dominance", 6).alias("dominance"))


@query()
def sentence_places(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's sentences with their places."""
    return sentences(load(spark, sf, "documents")).select("doc_id", "pos", "start", "end")


@query()
def span_places(spark: SparkSession, sf: str) -> DataFrame:
    """Where quotes from documents stand: every document's middle as it is, or with every twelfth character lost, or its beginning in capitals."""
    n = F.char_length("text")
    quote = F.substring(F.col("text"), (F.floor(n / 2) + 1).cast("int"), F.lit(80))
    blurred = F.regexp_replace(quote, r"(?s)(.{11}).", "$1")
    kind = F.col("doc_id") % 3
    span = F.when(kind == 0, quote).when(kind == 1, blurred).otherwise(F.upper(F.substring("text", 1, 60)))
    facts = load(spark, sf, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", span.alias("span"), F.col("text").alias("fact_text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return grounded(facts, "doc_id")


IDLE = 30 * 60_000


@query(f"""WITH e AS (SELECT user_id, event_type, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > {IDLE} * 1000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS key, min(ts) AS started, max(ts) AS ended, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM s GROUP BY user_id, k
HAVING epoch_ms(max(ts)) + {IDLE} <= (SELECT epoch_ms(max(ts)) FROM events) OR k < (SELECT max(k) FROM s t WHERE t.user_id = s.user_id)""")
def active_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """What users named in each session that has ended: list state, and a timer that half an hour of event time without a row sets off."""
    named = stream(spark, sf).select(F.col("user_id").cast("long").alias("key"), F.col("event_type").alias("name"), "ts")
    return run_states(named.withWatermark("ts", "0 seconds"), ActiveNames(IDLE), SESSION, "active")


@query("""WITH d AS (SELECT 'nation' AS name, md5(concat_ws('|', n_nationkey, n_name, n_regionkey)) AS h FROM nation UNION ALL SELECT 'region', md5(concat_ws('|', r_regionkey, r_name)) FROM region
UNION ALL SELECT 'events', md5(concat_ws('|', event_id, user_id, event_type)) FROM events) SELECT name, count(*) AS n_rows, sum(('0x' || substr(h, 1, 12))::BIGINT)::BIGINT AS digest FROM d GROUP BY name""")
def table_digests(spark: SparkSession, sf: str) -> DataFrame:
    """What a run's manifest keeps of its inputs: rows and a digest that no order changes."""
    columns = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "events": ["event_id", "user_id", "event_type"]}
    parts = [table_digest(load(spark, sf, t), c).select(F.lit(t).alias("name"), "n_rows", "digest") for t, c in columns.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query()
def replayed_run(spark: SparkSession, sf: str) -> DataFrame:
    """The layered embeddings, run twice and recorded: what differs between the runs' manifests, and how far their values are apart."""
    e = settle(edges(spark, sf), "run-edges")  # each layer and manifest of both runs reads them
    nodes = settle(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "run-nodes")
    ledger = Ledger(spark)
    results = []
    for n in (1, 2):
        given = e.repartition(2 * n, "dst")
        x = layered(given, seeded_features(nodes, DIMS), LAYERS)
        results.append(x.select("node", *(F.get("x", F.lit(k)).alias(f"x{k}") for k in range(OUT))))
        ledger.record(f"run-{n}", {"edges": e}, {"dims": DIMS, "layers": LAYERS}, {"embeddings": results[-1].select("node", *(F.round(f"x{k}", 6).alias(f"x{k}") for k in range(OUT)))})
    apart = compared(*results, ["node"], [f"x{k}" for k in range(OUT)]).withColumn("changed", F.lit(",".join(ledger.differences("run-1", "run-2"))))
    return apart


@query(f"WITH {KNN_SQL} SELECT query_id, rank, round(d, 3) AS d FROM near")
def index_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest points through a versioned index on disk: built, and refreshed when nothing has changed."""
    p = points(spark, sf).select("vec_id", F.col("p").alias("v"))
    dim = p.select(F.size("v")).first()
    index = VectorIndex(spark, new_path(spark, "vector-index"), dim[0] if dim else 0)
    index.refresh(p)
    index.refresh(p)
    held = index.read().select("vec_id", F.col("v").alias("p"))
    q = held.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("p").alias("q"))
    return search(build(held), q, 10).select("query_id", "rank", F.round("d", 3).alias("d"))


ANCHORS_SQL = rf"""entities AS (SELECT DISTINCT lower(regexp_extract(text, '^[^\s.,!?;:]+')) AS term FROM benchmark),
topics AS (SELECT w AS term FROM (SELECT item_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+')) AS w FROM benchmark) WHERE length(w) >= 6 GROUP BY w HAVING count(DISTINCT item_id) >= 2),
standards AS (SELECT canonical_value AS term FROM facts WHERE confidence >= 0.95 GROUP BY 1 HAVING count(*) >= 2),
disputed AS (SELECT fact_type, canonical_value FROM facts GROUP BY ALL HAVING count(DISTINCT negation) = 2),
on_topic AS (SELECT DISTINCT doc_id FROM tokens JOIN topics ON token = term)"""


@query(rf"""WITH {FACTS_SQL}, {TOKENS_SQL}, {ANCHORS_SQL},
a AS (SELECT f.doc_id, max((e.term IS NOT NULL)::INT) AS entity, max((s.term IS NOT NULL)::INT) AS standard, max((c.canonical_value IS NOT NULL)::INT) AS contradiction,
  max(regexp_matches(fact_text, '[12][0-9]{{3}}')::INT) AS dated, max((p.item_id IS NOT NULL)::INT) AS exact
  FROM facts f LEFT JOIN entities e ON e.term = f.canonical_value LEFT JOIN standards s ON s.term = f.canonical_value LEFT JOIN disputed c ON c.fact_type = f.fact_type AND c.canonical_value = f.canonical_value
  LEFT JOIN (SELECT min(item_id) AS item_id, text FROM benchmark GROUP BY text) p ON p.text = f.fact_text GROUP BY f.doc_id),
w AS (SELECT a.doc_id, exact, 0.3 * entity + 0.2 * (t.doc_id IS NOT NULL)::INT + 0.25 * dated + 0.3 * standard + 0.5 * contradiction AS weight FROM a LEFT JOIN on_topic t ON t.doc_id = a.doc_id)
SELECT doc_id, round(weight, 4)::DOUBLE AS weight, round(weight, 4) >= 0.5 OR exact = 1 AS priority FROM w""")
def anchored_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What documents share with tables of anchors: entities and topics of benchmark passages, standards, disputed values, years; and whether a sentence is a passage word for word."""
    f, b = facts(spark, sf), load(spark, sf, "benchmark")
    entities = b.select(F.lower(F.regexp_extract("text", r"^[^\s.,!?;:]+", 0)).alias("canonical_value")).distinct().withColumn("entity", F.lit(1))
    words = b.select("item_id", F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", " "), r"\s+")).alias("token")).where(F.length("token") >= 6)
    topics = words.groupBy("token").agg(F.count_distinct("item_id").alias("n")).where("n >= 2").select("token")
    standards = f.where("confidence >= 0.95").groupBy("canonical_value").agg(F.count("*").alias("n")).where("n >= 2").select("canonical_value", F.lit(1).alias("standard"))
    disputed = f.groupBy("fact_type", "canonical_value").agg(F.min("negation").alias("lo"), F.max("negation").alias("hi")).where("lo != hi").select("fact_type", "canonical_value", F.lit(1).alias("contradiction"))
    exact = b.select(F.col("text").alias("fact_text")).distinct().withColumn("exact", F.lit(1))
    marked = f.join(entities, "canonical_value", "left").join(standards, "canonical_value", "left").join(disputed, ["fact_type", "canonical_value"], "left").join(exact, "fact_text", "left")
    dated = F.col("fact_text").rlike("[12][0-9]{3}").cast("int")
    flags = marked.groupBy("doc_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("entity", "standard", "contradiction", "exact")), F.max(dated).alias("dated"))
    on_topic = tokens(spark, sf).join(topics, "token", "left_semi").select("doc_id").distinct().withColumn("topic", F.lit(1))
    weight = F.round(0.3 * F.col("entity") + 0.2 * F.coalesce("topic", F.lit(0)) + 0.25 * F.col("dated") + 0.3 * F.col("standard") + 0.5 * F.col("contradiction"), 4)
    return flags.join(on_topic, "doc_id", "left").select("doc_id", weight.alias("weight"), ((weight >= 0.5) | (F.col("exact") == 1)).alias("priority"))


@query(f"""WITH n AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')[1:{NAME_WORDS}])) AS aliases FROM documents),
q AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z0-9]+') AS alias FROM benchmark) SELECT doc_id, len(aliases) AS n_aliases FROM n WHERE EXISTS (SELECT 1 FROM q WHERE list_contains(n.aliases, q.alias))""")
def alias_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of which some alias, held as a JSON array, is asked for: the array becomes rows that meet the asked names, so no array is searched name by name."""
    nodes = load(spark, sf, "documents").select("doc_id", F.to_json(name_words(F.col("text"))).alias("aliases_json"))
    aliases = nodes.select("doc_id", F.from_json("aliases_json", "array<string>").alias("a")).select("doc_id", F.size("a").cast("long").alias("n_aliases"), F.explode("a").alias("alias"))
    asked = load(spark, sf, "benchmark").select(F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0).alias("alias")).distinct()
    return aliases.join(asked, "alias", "left_semi").select("doc_id", "n_aliases").distinct()


@query(rf"""WITH {FACTS_SQL}, t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')[1:{NAME_WORDS}]) AS title FROM documents),
s AS (SELECT f.doc_id, fact_id, confidence, len(list_intersect(title, list_distinct(regexp_extract_all(lower(fact_text), '[a-z0-9]+'))))::DOUBLE / greatest(len(title), 1) AS score FROM facts f JOIN t USING (doc_id))
SELECT doc_id, fact_id, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, confidence DESC, fact_id) AS rank FROM s""")
def ingest_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """A document's facts in the order of how much of its title (its first words) they say again, then of confidence."""
    titles = load(spark, sf, "documents").select("doc_id", name_words(F.col("text")).alias("title"))
    said = F.array_distinct(F.regexp_extract_all(F.lower("fact_text"), F.lit("([a-z0-9]+)")))
    score = F.round(F.size(F.array_intersect("title", said)) / F.greatest(F.size("title"), F.lit(1)), 6)
    f = facts(spark, sf).join(titles, "doc_id").select("doc_id", "fact_id", "confidence", score.alias("score"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("confidence"), "fact_id"))).drop("confidence")


@query()
def routed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The two E8 cells, of those that hold vectors, nearest to each row whose id is divisible by 20, and how many vectors they hold; all coordinates count."""
    v = load(spark, sf, "embeddings").select("vec_id", G.doubles(F.col("embedding")).alias("v"))
    return route_cells(v.where("vec_id % 20 = 0"), v, 2)
