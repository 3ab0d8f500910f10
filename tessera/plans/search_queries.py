"""Search, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from .common import FACTS_SQL, TOKENS_SQL, facts, tokens
from .registry import load, query

TERMS, PHRASE = ["tion", "edre", "whou"], "thatst reand"


def _score_sql(col: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower({col}), '{t}') THEN {max(1.0, len(t) / 4)} ELSE 0 END" for t in TERMS) + f" + CASE WHEN contains(lower({col}), '{PHRASE}') THEN {2.0 * len(PHRASE.split())} ELSE 0 END"


@query(f"SELECT * FROM (SELECT doc_id, ({_score_sql('text')})::DOUBLE AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def chunk_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: lexical search over whole texts, the best 20."""
    return S.chunk_search(load(spark, sf, "documents"), TERMS, PHRASE, 20)


@query(f"WITH {TOKENS_SQL} SELECT token, doc_id, count(*) AS n FROM tokens GROUP BY ALL")
def posting_list(spark: SparkSession, sf: str) -> DataFrame:
    return S.postings(load(spark, sf, "documents")).select("token", "doc_id", "n")


@query(f"""WITH {FACTS_SQL}, s AS (SELECT fact_id, confidence, CASE WHEN contains(lower(fact_text), 'the of') THEN 100.0 ELSE 100.0 * len(list_intersect(list_distinct(string_split(lower(fact_text), ' ')), ['the', 'of'])) / 2 END AS fuzzy FROM facts WHERE fact_text ILIKE '%the of%' OR canonical_value ILIKE '%the%')
SELECT fact_id, round(0.6 * confidence + 0.4 * fuzzy / 100, 6) AS score FROM s ORDER BY score DESC, fact_id LIMIT 30""")
def keyword_fact_search(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    hits = f.where(f.fact_text.ilike("%the of%") | f.canonical_value.ilike("%the%"))
    return hits.select("fact_id", F.round(S.fact_score(F.col("confidence"), S.fuzzy_ratio(F.lit("the of"), F.col("fact_text"))), 6).alias("score")).orderBy(F.desc("score"), "fact_id").limit(30)


STAGES_SQL = f"""{FACTS_SQL}, a AS (SELECT fact_id, confidence AS score FROM facts WHERE canonical_value = 'the' ORDER BY score DESC, fact_id LIMIT 100),
b AS (SELECT fact_id, length(fact_text)::DOUBLE AS score FROM facts WHERE contains(lower(fact_text), 'edre') ORDER BY score DESC, fact_id LIMIT 100),
fused AS (SELECT fact_id, sum(w / (60 + rn)) AS fused FROM (
  SELECT fact_id, 0.6 AS w, row_number() OVER (ORDER BY score DESC, fact_id) AS rn FROM a UNION ALL
  SELECT fact_id, 0.4, row_number() OVER (ORDER BY score DESC, fact_id) FROM b) GROUP BY fact_id)"""


def stages(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    best = lambda x, score: x.select("fact_id", score.cast("double").alias("score")).orderBy(F.desc("score"), "fact_id").limit(100)
    a, b = best(f.where("canonical_value = 'the'"), F.col("confidence")), best(f.where(F.contains(F.lower("fact_text"), F.lit("edre"))), F.char_length("fact_text"))
    return S.fused({"graph": a, "vector": b}, {"graph": 0.6, "vector": 0.4}, "fact_id")


@query(f"WITH {STAGES_SQL} SELECT fact_id, round(fused, 8) AS fused FROM fused")
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return stages(spark, sf).select("fact_id", F.round("fused", 8).alias("fused"))


@query(rf"""WITH {STAGES_SQL}, q AS (SELECT ['thatst', 'reand', 'eration'] AS w),
t AS (SELECT fact_id, confidence, list_filter(regexp_split_to_array(regexp_replace(lower(fact_text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1) AS w FROM facts JOIN fused USING (fact_id)),
s AS (SELECT fact_id, confidence, len(list_intersect(t.w, q.w))::DOUBLE / 3 AS overlap, len(list_intersect(t.w, ['thatst', 'eration']))::DOUBLE / 2 AS rare FROM t, q)
SELECT fact_id, round(0.45 * 0.5 + 0.30 * (0.6 * overlap + 0.4 * rare) + 0.15 * 1.0 + 0.10 * confidence, 6) AS score FROM s ORDER BY score DESC, fact_id LIMIT 500""")
def fused_final_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion decides who is in; the final score decides the order."""
    words = F.array(*map(F.lit, ["thatst", "reand", "eration"]))
    f = facts(spark, sf).join(F.broadcast(stages(spark, sf).select("fact_id")), "fact_id").withColumn("w", T.tokenize(F.col("fact_text"), ("",)))
    overlap = F.size(F.array_intersect("w", words)) / 3
    score = S.final_score(F.lit(0.5), overlap, T.rare_share(words, F.col("w")), F.lit(1.0), F.col("confidence"))
    return f.select("fact_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "fact_id").limit(500)


@query(f"""WITH {FACTS_SQL} SELECT fact_id, round((CASE WHEN contains(fact_text, 'tion') THEN 1.0 ELSE 0.2 END) * (CASE WHEN fact_type = 1 THEN 1.2 ELSE 1.0 END) + 0.3 * confidence, 6) AS score FROM facts ORDER BY score DESC, fact_id LIMIT 50""")
def fallback_ranking(spark: SparkSession, sf: str) -> DataFrame:
    overlap = F.when(F.contains("fact_text", F.lit("tion")), 1.0).otherwise(0.2)
    return facts(spark, sf).select("fact_id", F.round(S.fallback_score(overlap, F.col("fact_type") == 1, F.col("confidence")), 6).alias("score")).orderBy(F.desc("score"), "fact_id").limit(50)


@query(r"""SELECT p_partkey, regexp_extract(p_name, '([0-9]+)', 1) AS number FROM part WHERE regexp_matches(p_name, '(?i)\b(part|episode)?[ #]*0*7\b') OR regexp_extract(p_name, '([0-9]+)', 1) LIKE '%77'""")
def direct_references(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").withColumn("number", F.regexp_extract("p_name", "([0-9]+)", 1))
    return p.where(p.p_name.rlike(r"(?i)\b(part|episode)?[ #]*0*7\b") | F.col("number").like("%77")).select("p_partkey", "number")


@query(f"""WITH {FACTS_SQL}, c AS (SELECT doc_id, count(*) AS n FROM facts WHERE contains(lower(fact_text), 'edre') GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 3)
SELECT 'document' AS kind, doc_id, doc_id AS item, 0.95 AS confidence FROM c UNION ALL
SELECT 'summary', doc_id, min(fact_id), 0.9 FROM facts JOIN c USING (doc_id) GROUP BY doc_id UNION ALL
SELECT 'fact', doc_id, fact_id, confidence FROM facts JOIN c USING (doc_id) WHERE contains(lower(fact_text), 'edre')""")
def hierarchical_points(spark: SparkSession, sf: str) -> DataFrame:
    """The three best documents, with their summaries and matching facts."""
    f = facts(spark, sf)
    hits = f.where(F.contains(F.lower("fact_text"), F.lit("edre")))
    best = F.broadcast(hits.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(3).select("doc_id"))
    row = lambda df, kind, item, conf: df.select(F.lit(kind).alias("kind"), "doc_id", item.alias("item"), conf.cast("double").alias("confidence"))
    docs = row(best, "document", F.col("doc_id"), F.lit(0.95))
    summary = row(f.join(best, "doc_id").groupBy("doc_id").agg(F.min("fact_id").alias("m")), "summary", F.col("m"), F.lit(0.9))
    return docs.unionByName(summary).unionByName(row(hits.join(best, "doc_id"), "fact", F.col("fact_id"), F.col("confidence")))


@query(f"""WITH {TOKENS_SQL}, c AS (SELECT token, source, count(*) AS w FROM tokens GROUP BY ALL) SELECT b.token, sum(a.w * b.w) AS weight FROM c a JOIN c b ON a.source = b.source AND a.token = 'thatthe' AND b.token <> 'thatthe' GROUP BY b.token HAVING sum(a.w * b.w) >= 3""")
def related_keywords(spark: SparkSession, sf: str) -> DataFrame:
    c = tokens(spark, sf).groupBy("token", "source").agg(F.count("*").alias("w"))
    mine = c.where("token = 'thatthe'").select("source", F.col("w").alias("mw"))
    return c.where("token <> 'thatthe'").join(mine, "source").groupBy("token").agg(F.sum(F.col("w") * F.col("mw")).alias("weight")).where("weight >= 3")


@query("""WITH r AS (SELECT label AS query, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 1009, vec_id) AS rank FROM embeddings), rel AS (SELECT label AS query, vec_id AS item FROM embeddings WHERE vec_id % 10 = 0),
p AS (SELECT rel.query, count(*) AS wanted FROM rel GROUP BY 1), h AS (SELECT r.query, sum(CASE WHEN rank <= 10 AND rel.item IS NOT NULL THEN 1 ELSE 0 END) AS found, max(CASE WHEN rel.item IS NOT NULL THEN 1.0 / rank END) AS rr FROM r LEFT JOIN rel USING (query, item) GROUP BY 1)
SELECT round(avg(coalesce(found, 0)::DOUBLE / wanted), 6) AS recall, round(avg(coalesce(found, 0) / 10.0), 6) AS precision, round(avg(coalesce(rr, 0)), 6) AS mrr FROM p LEFT JOIN h USING (query)""")
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = load(spark, sf, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("item"))
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.expr("(item * 7919) % 1009"), "item")))
    m = S.retrieval_metrics(ranked, e.where("item % 10 = 0"), 10)
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"""WITH {FACTS_SQL} SELECT doc_id, count(*) AS n_anchors, least(max(confidence), 1.0) AS best, list_sort(list(fact_id)) AS anchor_ids FROM facts WHERE confidence >= 0.9 GROUP BY doc_id""")
def evidence_contracts(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).where("confidence >= 0.9").groupBy("doc_id")
    return f.agg(F.count("*").alias("n_anchors"), F.least(F.max("confidence"), F.lit(1.0)).alias("best"), F.array_sort(F.collect_list("fact_id")).alias("anchor_ids"))
