"""Connected components of an edge table, in shuffles alone: large-star and small-star in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Every node's smaller neighbours meet its least one; the least is found before rows are shuffled (partial sums)."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = sides.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b: long, durable): root is the least node that can be reached.

    Each round's edges are written, so that no lineage grows and a lost executor
    costs one round. No edges give no rows; loops and repeats are harmless.
    """
    now, before = edges.where("a != b"), None
    for _ in range(rounds):
        now = durable(_stars(_stars(now, True), False), "star-edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
