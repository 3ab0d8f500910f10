"""Stand-ins on the given tables for facts, tokens, graphs and points, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .registry import load

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
TOKENS_SQL = f"""tokens AS (
  SELECT doc_id, source, w AS token FROM (
    SELECT doc_id, source, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS w FROM documents
  ) WHERE length(w) > 1 AND w NOT IN {STOP_SQL})"""
FACTS_SQL = """sentences AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS s FROM documents
), cut AS (
  SELECT doc_id, unnest(s) AS fact_text, unnest(range(len(s))) AS pos FROM sentences
), facts AS (
  SELECT doc_id * 10000 + pos AS fact_id, doc_id, pos, fact_text,
    ((doc_id * 10000 + pos) * 37 % 100) / 100.0::DOUBLE AS confidence,
    lower(regexp_extract(fact_text, '^[^\\s.,!?;:]+')) AS canonical_value,
    ((doc_id * 10000 + pos) % 7 = 0) AS negation, (doc_id * 10000 + pos) % 5 AS fact_type
  FROM cut WHERE length(fact_text) > 0)"""
SIDES_SQL = """sides AS (
  SELECT fact_type, canonical_value, negation, count(*) AS links, min(fact_id) AS first, first(fact_id ORDER BY confidence DESC, fact_id) AS strongest FROM facts GROUP BY ALL)"""
EDGES_SQL = """edges AS (
  SELECT l_suppkey AS src, 1000000 + l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL)"""
TRIPLES_SQL = """triples AS (
  SELECT 'c' || c_custkey AS subject, 'located_in' AS predicate, 'n' || c_nationkey AS object FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'located_in', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation)"""
POINTS_SQL = """raw AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), points AS (
  SELECT vec_id, label, list_transform(v, lambda x: x * tanh(sqrt(list_inner_product(v, v)) / 2) / sqrt(list_inner_product(v, v))) AS p FROM raw)"""


def distance_sql(a: str, b: str) -> str:
    """Distance of two points of the ball, as SQL."""
    ab = f"(list_inner_product({a}, {a}) + list_inner_product({b}, {b}) - 2 * list_inner_product({a}, {b}))"
    return f"acosh(greatest(1.0, 1 + 2 * greatest({ab}, 0) / greatest((1 - list_inner_product({a}, {a})) * (1 - list_inner_product({b}, {b})), 1e-12)))"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return docs.select("doc_id", "source", F.explode(T.tokenize(F.col("text"))).alias("token"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences as facts, with a made-up confidence, type and negation."""
    cut = load(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "fact_text")).where(F.length("fact_text") > 0)
    f = cut.withColumn("fact_id", F.col("doc_id") * 10000 + F.col("pos"))
    return f.select(
        "fact_id", "doc_id", F.col("pos").cast("long").alias("pos"), "fact_text", ((F.col("fact_id") * 37 % 100) / 100.0).alias("confidence"),
        F.lower(F.regexp_extract("fact_text", r"^[^\s.,!?;:]+", 0)).alias("canonical_value"), (F.col("fact_id") % 7 == 0).alias("negation"), (F.col("fact_id") % 5).alias("fact_type"),
    )


def opposed(facts: DataFrame) -> DataFrame:
    """Facts with what stands against them in their type and value: links (how many), first and strongest.

    A side is summed up before it meets the other, so no pairs of a group are made.
    """
    strongest = F.min_by("fact_id", F.struct(-F.col("confidence"), "fact_id"))
    sides = facts.groupBy("fact_type", "canonical_value", (~F.col("negation")).alias("negation")).agg(F.count("*").alias("links"), F.min("fact_id").alias("first"), strongest.alias("strongest"))
    return facts.join(sides, ["fact_type", "canonical_value", "negation"])


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier and part, weighted by line items; parts are numbered from 1,000,000."""
    items = load(spark, sf, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).agg(F.count("*").alias("weight"))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name, s, key, p, o, ref: load(spark, sf, name).select(F.concat(F.lit(s), F.col(key)).alias("subject"), F.lit(p).alias("predicate"), F.concat(F.lit(o), F.col(ref)).alias("object"))
    return t("customer", "c", "c_custkey", "located_in", "n", "c_nationkey").unionByName(t("supplier", "s", "s_suppkey", "located_in", "n", "s_nationkey")).unionByName(t("nation", "n", "n_nationkey", "part_of", "r", "n_regionkey"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings, mapped once into the ball."""
    return load(spark, sf, "embeddings").select("vec_id", "label", G.exp0(G.doubles(F.col("embedding"))).alias("p"))
