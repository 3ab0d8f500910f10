"""Lexical search over posting lists, rank fusion, linear rankers and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, key, n): how often a document holds a token; summed before the shuffle."""
    return docs.select(key, F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))


def chunk_search(docs: DataFrame, terms: list[str], phrase: str, k: int, key: str = "doc_id") -> DataFrame:
    """Documents that hold a term: max(1, length/4) for each, and 2 per word for the whole phrase; the best k.

    The terms are known when the plan is made, so the search is one scan without a
    join or an index; only the best k of each task are sorted together.
    """
    low = F.lower("text")
    score = sum((F.when(F.contains(low, F.lit(t)), F.lit(max(1.0, len(t) / 4))).otherwise(F.lit(0.0)) for t in terms), F.lit(0.0))
    score = score + F.when(F.contains(low, F.lit(phrase)), F.lit(2.0 * len(phrase.split()))).otherwise(F.lit(0.0))
    return docs.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def fused(stages: dict[str, DataFrame], weights: dict[str, float], key: str, k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of stages (key, score): sum of weight / (k + rank). Unknown stages weigh 0."""
    out = None
    for name, df in stages.items():
        # stages are candidate lists that earlier steps cut to their best rows
        r = df.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"), F.lit(float(weights.get(name, 0.0))).alias("w"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy(key).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("fused"))


def final_score(hyperbolic: Column, overlap: Column, rare: Column, graph: Column, confidence: Column) -> Column:
    return 0.45 * hyperbolic + 0.30 * (0.6 * overlap + 0.4 * rare) + 0.15 * graph + 0.10 * confidence


def fallback_score(overlap: Column, is_fact: Column, confidence: Column) -> Column:
    return overlap * F.when(is_fact, 1.2).otherwise(1.0) + 0.3 * confidence


def fact_score(confidence: Column, fuzzy: Column) -> Column:
    """Confidence and fuzzy ratio (0 to 100)."""
    return 0.6 * confidence + 0.4 * fuzzy / 100


def fuzzy_ratio(query: Column, text: Column) -> Column:
    """Token-set likeness, 0 to 100; 100 where the query stands in the text. A stand-in for edit-based ratios."""
    a, b = F.array_distinct(F.split(F.lower(query), " ")), F.array_distinct(F.split(F.lower(text), " "))
    return F.when(F.contains(F.lower(text), F.lower(query)), 100.0).otherwise(100.0 * F.size(F.array_intersect(a, b)) / F.size(a))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Mean recall@k, precision@k and reciprocal rank. ranked: query, item, rank; relevant: query, item."""
    hits = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query", "item"], "left")
    per = hits.groupBy("query").agg(
        F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1).otherwise(0)).alias("found"), F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))).alias("rr")
    )
    wanted = relevant.groupBy("query").agg(F.count("*").alias("wanted"))
    j = wanted.join(per, "query", "left").fillna(0, ["found", "rr"])
    return j.agg(F.avg(F.col("found") / F.col("wanted")).alias("recall"), F.avg(F.col("found") / k).alias("precision"), F.avg("rr").alias("mrr"))
