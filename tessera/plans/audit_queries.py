"""Verification, auditing, gaps, memory and tier-B blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import relational as R
from .common import EDGES_SQL, FACTS_SQL, SIDES_SQL, TOKENS_SQL, TRIPLES_SQL, edges, facts, points, tokens, triples
from .registry import load, query

CONTRA_SQL = f"""{FACTS_SQL}, {SIDES_SQL}, c AS (
  SELECT 'negation' AS kind, f.fact_id AS a, s.strongest AS b, s.links FROM facts f JOIN sides s ON f.fact_type = s.fact_type AND f.canonical_value = s.canonical_value AND f.negation <> s.negation
  UNION ALL SELECT 'text', a.fact_id, min({{'c': -b.confidence, 'i': b.fact_id}}).i, count(*) FROM facts a JOIN facts b ON a.fact_type = b.fact_type AND a.canonical_value = b.canonical_value AND a.fact_text <> b.fact_text GROUP BY a.fact_id)"""


@query(f"WITH {CONTRA_SQL} SELECT kind, a, b, links FROM c")
def contradiction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return contradictions(spark, sf).select("kind", "a", "b", "links")


@query(f"""WITH {CONTRA_SQL}
SELECT kind, a, b, links, CASE WHEN abs(x.confidence - y.confidence) > 0.2 THEN CASE WHEN x.confidence < y.confidence THEN 'drop a' ELSE 'drop b' END ELSE 'review' END AS decision FROM c JOIN facts x ON x.fact_id = a JOIN facts y ON y.fact_id = b""")
def contradiction_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return contradictions(spark, sf)


def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Each fact that others of its type and value contradict anywhere in the corpus: the strongest of them, how many there are, and what to do.

    kind: by negation, or by another text (these facts have no validity, so all count as valid
    at one time).
    """
    place, code = 1 << 50, (100 - F.round(F.col("confidence") * 100).cast("long")) * (1 << 50) + F.col("fact_id")  # confidence is in hundredths; the least code is the strongest fact
    # groups and texts by 64-bit hashes, a text by both
    f = facts(spark, sf).select(F.xxhash64("fact_type", "canonical_value").alias("g"), F.xxhash64("fact_text").alias("t"), code.alias("code"), "negation")
    no, yes = F.when(F.col("negation"), F.col("code")), F.when(~F.col("negation"), F.col("code"))
    # sums of equal texts, then of groups, are taken before facts meet them: no pairs of a group are made
    texts = f.groupBy("g", "t").agg(F.min("code").alias("own"), F.count("*").alias("n"), F.min(no).alias("no"), F.min(yes).alias("yes"), F.count(no).alias("n_no"))
    groups = texts.groupBy("g").agg(F.min("own").alias("first"), F.sum("n").alias("all"), F.min("no").alias("no"), F.min("yes").alias("yes"), F.sum("n_no").alias("n_no"))
    both = texts.select("g", "t", "own", "n").join(groups, "g")
    second = both.where("own > first").groupBy("g").agg(F.min("own").alias("second"))
    each = both.join(second, "g", "left").where("second IS NOT NULL OR no IS NOT NULL AND yes IS NOT NULL").select(
        "g", "t", F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"), (F.col("all") - F.col("n")).alias("links"), "no", "yes", "n_no", (F.col("all") - F.col("n_no")).alias("n_yes")
    )
    met = f.join(each, ["g", "t"])
    kind = lambda name, other, n: F.struct(F.lit(name).alias("kind"), other.alias("other"), n.alias("links"))
    negated = F.col("negation")
    kinds = F.array(kind("negation", F.when(negated, F.col("yes")).otherwise(F.col("no")), F.when(negated, F.col("n_yes")).otherwise(F.col("n_no"))), kind("text", F.col("other"), F.col("links")))
    rows = met.select("code", F.explode(kinds).alias("x")).select("code", "x.*").where("links > 0")
    fact, sure = lambda c: F.col(c) % place, lambda c: (100 - F.shiftright(c, 50)) / 100.0
    ca, cb = sure("code"), sure("other")
    decision = F.when(F.abs(ca - cb) > 0.2, F.when(ca < cb, "drop a").otherwise("drop b")).otherwise("review")
    return rows.select("kind", fact("code").alias("a"), fact("other").alias("b"), "links", decision.alias("decision"))


@query(f"""WITH {FACTS_SQL}, l AS (SELECT f.fact_id, contains(d.text, f.fact_text) AS grounding, f.confidence >= 0.8 AS vericot, f.confidence >= 0.9 AS fidelis, f.confidence >= 0.7 AS rcot FROM facts f JOIN documents d USING (doc_id))
SELECT fact_id, grounding, vericot, fidelis, rcot, round((grounding::INT + vericot::INT + fidelis::INT + rcot::INT) / 4.0, 4) AS ares FROM l""")
def verification_layers(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).join(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    layers = {"grounding": F.contains("text", F.col("fact_text")), "vericot": F.col("confidence") >= 0.8, "fidelis": F.col("confidence") >= 0.9, "rcot": F.col("confidence") >= 0.7}
    mean = sum((c.cast("int") for c in layers.values()), F.lit(0)) / 4
    return f.select("fact_id", *(c.alias(n) for n, c in layers.items()), F.round(mean, 4).alias("ares"))


@query(f"""WITH {FACTS_SQL}, {EDGES_SQL}, d AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY src)
SELECT 'low confidence' AS kind, fact_id AS item, round(1 - confidence, 6) AS priority FROM facts WHERE confidence < 0.1
UNION ALL SELECT 'few edges', s_suppkey, round(1.0 / (1 + coalesce(n, 0)), 6) FROM supplier LEFT JOIN d ON d.id = s_suppkey WHERE coalesce(n, 0) < 60
UNION ALL SELECT 'unconnected', p_partkey, 1.0 FROM part WHERE NOT EXISTS (SELECT 1 FROM edges WHERE dst = 1000000 + p_partkey)
UNION ALL SELECT 'no quotes', doc_id, 0.5 FROM documents WHERE NOT EXISTS (SELECT 1 FROM facts WHERE facts.doc_id = documents.doc_id AND facts.confidence > 0.9)""")
def knowledge_gaps(spark: SparkSession, sf: str) -> DataFrame:
    f, e = facts(spark, sf), edges(spark, sf)
    row = lambda df, kind, item, p: df.select(F.lit(kind).alias("kind"), item.cast("long").alias("item"), F.round(p, 6).alias("priority"))
    low = row(f.where("confidence < 0.1"), "low confidence", F.col("fact_id"), 1 - F.col("confidence"))
    deg = e.groupBy(F.col("src").alias("s_suppkey")).agg(F.count("*").alias("n"))
    few = row(load(spark, sf, "supplier").join(deg, "s_suppkey", "left").fillna(0, ["n"]).where("n < 60"), "few edges", F.col("s_suppkey"), 1.0 / (1 + F.col("n")))
    alone = row(load(spark, sf, "part").withColumn("dst", F.col("p_partkey") + 1000000).join(e, "dst", "left_anti"), "unconnected", F.col("p_partkey"), F.lit(1.0))
    bare = row(load(spark, sf, "documents").join(f.where("confidence > 0.9"), "doc_id", "left_anti"), "no quotes", F.col("doc_id"), F.lit(0.5))
    return low.unionByName(few).unionByName(alone).unionByName(bare)


@query(f"""WITH {TOKENS_SQL} SELECT 'over general' AS flag, token AS item FROM tokens GROUP BY token HAVING count(DISTINCT source) > 15
UNION ALL SELECT 'weak', c_name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'junk', token FROM tokens WHERE length(token) <= 2 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY token""")
def cleanup_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(spark, sf)
    row = lambda df, flag, item: df.select(F.lit(flag).alias("flag"), F.col(item).alias("item"))
    wide = row(t.groupBy("token").agg(F.countDistinct("source").alias("n")).where("n > 15"), "over general", "token")
    weak = row(load(spark, sf, "customer").where("c_acctbal < 0"), "weak", "c_name")
    return wide.unionByName(weak).unionByName(row(t.where((F.length("token") <= 2) & ~F.col("token").rlike("^[0-9]+$")).select("token").distinct(), "junk", "token"))


@query(f"""WITH {FACTS_SQL}, t AS (SELECT doc_id, fact_type, count(*)::DOUBLE AS n FROM facts GROUP BY ALL), p AS (SELECT doc_id, fact_type, n / sum(n) OVER (PARTITION BY doc_id) AS p, count(*) OVER (PARTITION BY doc_id) AS k FROM t)
SELECT doc_id, round(log2(any_value(k)) + sum(p * log2(p)), 5) AS bits, max(p) > 0.5 AND log2(any_value(k)) + sum(p * log2(p)) >= 1 AS accepted FROM p GROUP BY doc_id""")
def fidelity_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Bits that candidates' shares give over an even choice."""
    n = facts(spark, sf).groupBy("doc_id", "fact_type").agg(F.count("*").cast("double").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")))
    g = p.groupBy("doc_id").agg((F.log2(F.count("*")) + F.sum(F.col("p") * F.log2("p"))).alias("b"), F.max("p").alias("top"))
    return g.select("doc_id", F.round("b", 5).alias("bits"), ((F.col("top") > 0.5) & (F.col("b") >= 1)).alias("accepted"))


@query(f"WITH {FACTS_SQL} SELECT doc_id, round(max(confidence) - min(confidence), 6) AS margin, round(exp(-1.0 * (max(confidence) - min(confidence))), 6) AS coherence, exp(-1.0 * (max(confidence) - min(confidence))) < 0.4 AS review FROM facts GROUP BY doc_id")
def decoherence(spark: SparkSession, sf: str) -> DataFrame:
    g = facts(spark, sf).groupBy("doc_id").agg((F.max("confidence") - F.min("confidence")).alias("d"))
    return g.select("doc_id", F.round("d", 6).alias("margin"), F.round(F.exp(-F.col("d")), 6).alias("coherence"), (F.exp(-F.col("d")) < 0.4).alias("review"))


@query(f"""WITH {FACTS_SQL}, a AS (SELECT doc_id, max(CASE WHEN canonical_value = 'the' THEN 0.3 ELSE 0 END) AS e, max(CASE WHEN contains(fact_text, 'edre') THEN 0.2 ELSE 0 END) AS t, max(CASE WHEN regexp_matches(fact_text, '[0-9]') THEN 0.25 ELSE 0 END) AS d FROM facts GROUP BY doc_id) SELECT doc_id, round(e + t + d, 4) AS weight, e + t + d >= 0.5 AS priority FROM a""")
def recall_priority(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda c, w: F.max(F.when(c, w).otherwise(0.0))
    a = facts(spark, sf).groupBy("doc_id").agg(has(F.col("canonical_value") == "the", 0.3).alias("e"), has(F.contains("fact_text", F.lit("edre")), 0.2).alias("t"), has(F.col("fact_text").rlike("[0-9]"), 0.25).alias("d"))
    s = F.col("e") + F.col("t") + F.col("d")
    return a.select("doc_id", F.round(s, 4).alias("weight"), (s >= 0.5).alias("priority"))


@query(f"WITH {FACTS_SQL}, k AS (SELECT * FROM facts WHERE confidence >= 0.95), v AS (SELECT canonical_value, min(fact_id) AS standard, count(*) AS evidence FROM k GROUP BY 1) SELECT * FROM v WHERE evidence >= 2")
def promoted_standards(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).where("confidence >= 0.95").groupBy("canonical_value").agg(F.min("fact_id").alias("standard"), F.count("*").alias("evidence")).where("evidence >= 2")


@query(f"WITH {FACTS_SQL}, t AS (SELECT * FROM facts WHERE canonical_value = 'the' ORDER BY confidence DESC, fact_id LIMIT 25), k AS (SELECT * FROM t WHERE confidence >= 0.6) SELECT d.doc_id, length(d.text) AS n FROM documents d WHERE doc_id IN (SELECT doc_id FROM k)")
def verified_documents(spark: SparkSession, sf: str) -> DataFrame:
    k = facts(spark, sf).where("canonical_value = 'the'").orderBy(F.desc("confidence"), "fact_id").limit(25).where("confidence >= 0.6").select("doc_id")
    return load(spark, sf, "documents").join(F.broadcast(k), "doc_id", "left_semi").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND b.vec_id <= a.vec_id + 3")
def contrastive_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", "label")
    a = e.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("b"))
    return a.join(e.select(F.col("vec_id").alias("b"), "label"), "b").select("a", "b", (F.col("la") == F.col("label")).alias("same"))


@query(f"WITH {FACTS_SQL} SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM facts WHERE confidence > 0.9 GROUP BY 1) f USING (doc_id) WHERE length(d.text) > 500 AND coalesce(n, 0) = 0")
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").where(F.char_length("text") > 500).join(facts(spark, sf).where("confidence > 0.9").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query(f"WITH {FACTS_SQL} SELECT fact_type, canonical_value AS mention, max(confidence) AS confidence, count(*) AS n FROM facts GROUP BY ALL")
def merged_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).groupBy("fact_type", F.col("canonical_value").alias("mention")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@query("SELECT DISTINCT lower(v) AS keyword FROM (SELECT c_mktsegment AS v FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)")
def seed_keywords(spark: SparkSession, sf: str) -> DataFrame:
    col = lambda t, c: load(spark, sf, t).select(F.lower(c).alias("keyword"))
    return col("customer", "c_mktsegment").unionAll(col("nation", "n_name")).unionAll(col("region", "r_name")).distinct()


@query(f"WITH {TOKENS_SQL}, k AS (SELECT token, source, count(*) AS w FROM tokens GROUP BY ALL) SELECT source, count(*) AS kept FROM k WHERE w >= 3 AND length(token) > 2 GROUP BY source")
def pruned_keyword_edges(spark: SparkSession, sf: str) -> DataFrame:
    k = tokens(spark, sf).groupBy("token", "source").agg(F.count("*").alias("w"))
    return k.where("w >= 3 AND length(token) > 2").groupBy("source").agg(F.count("*").alias("kept"))


@query("""SELECT conv_id, count(*) AS events, max_by(role, turn) AS last_role, CASE WHEN max(turn) >= 6 THEN 'canon' WHEN max(turn) >= 3 THEN 'review' ELSE 'open' END AS gate FROM conversations GROUP BY conv_id""")
def process_gates(spark: SparkSession, sf: str) -> DataFrame:
    gate = F.when(F.max("turn") >= 6, "canon").when(F.max("turn") >= 3, "review").otherwise("open")
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("events"), F.max_by("role", "turn").alias("last_role"), gate.alias("gate"))


@query(f"""WITH {FACTS_SQL}, g AS (SELECT fact_id AS item, CASE WHEN confidence < 0.05 THEN 'low confidence' WHEN negation THEN 'no relations' ELSE 'under-explored' END AS kind, confidence FROM facts)
SELECT kind, item FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence, item) AS r FROM g) WHERE r <= 5""")
def gap_queue(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("confidence") < 0.05, "low confidence").when(F.col("negation"), "no relations").otherwise("under-explored")
    g = facts(spark, sf).select(F.col("fact_id").alias("item"), kind.alias("kind"), "confidence")
    return R.top_by(g, ["kind"], [F.col("confidence"), F.col("item")], 5).select("kind", "item")


@query(f"WITH {TRIPLES_SQL} SELECT sha256(subject || chr(0) || predicate || chr(0) || object) AS id, subject FROM triples")
def provenance_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import material_hash

    return triples(spark, sf).select(material_hash(F.col("subject"), F.col("predicate"), F.col("object")).alias("id"), "subject")


@query("""WITH c AS (SELECT conv_id, turn, text, (turn * 37 % 100) / 100.0 AS sim, (max(turn) OVER (PARTITION BY conv_id) - turn) * 3600.0 AS age FROM conversations), s AS (SELECT *, sim * exp(-0.0001 * age) AS score FROM c)
SELECT conv_id, turn, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS r FROM s) WHERE r <= 2""")
def memory_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity, decayed by age; the best two of each session."""
    age = (F.max("turn").over(Window.partitionBy("conv_id")) - F.col("turn")) * 3600.0
    s = load(spark, sf, "conversations").withColumn("score", (F.col("turn") * 37 % 100) / 100.0 * F.exp(-0.0001 * age))
    return R.top_by(s, ["conv_id"], [F.desc("score"), F.col("turn")], 2).select("conv_id", "turn", F.round("score", 6).alias("score"))


@query()
def packed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return B.chunks(load(spark, sf, "documents")).select("doc_id", "chunk_index", F.char_length("chunk").alias("n"))


@query()
def read_html_pages(spark: SparkSession, sf: str) -> DataFrame:
    return B.read_pages(load(spark, sf, "pages")).select("page_id", "title", F.md5("text").alias("digest"), F.size("links").alias("n_links"))


@query()
def calibrated_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return B.calibrated(facts(spark, sf)).select("fact_id", F.round("calibrated", 6).alias("calibrated"))


@query()
def novelty_gate(spark: SparkSession, sf: str) -> DataFrame:
    return B.novel(B.chunks(load(spark, sf, "documents")))


@query()
def batch_verification(spark: SparkSession, sf: str) -> DataFrame:
    return B.batch_verify(facts(spark, sf))


@query()
def lattice_routing(spark: SparkSession, sf: str) -> DataFrame:
    return B.lattice_cells(load(spark, sf, "embeddings")).groupBy("cell").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@query()
def quantisation_error(spark: SparkSession, sf: str) -> DataFrame:
    return B.quantised_error(load(spark, sf, "embeddings")).select("vec_id", F.round("error", 5).alias("error"))


@query()
def collective_links(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    c = f.select("doc_id", F.concat(F.lit("m"), F.col("pos")).alias("mention"), F.explode(F.array(F.col("fact_id"), F.col("fact_id") + 1)).alias("candidate"), "confidence")
    return B.link_mentions(c.select("doc_id", "mention", "candidate", ((F.col("candidate") * 13 % 10) / 10.0).alias("score"), (F.col("candidate") % 3).cast("string").alias("group")))


@query()
def session_state(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").cast("double").alias("v"))
    return B.session_centroids(t).select("conv_id", "turn", F.round("x", 6).alias("x"))


@query()
def shard_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return B.shard_axes(points(spark, sf)).select("vec_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
