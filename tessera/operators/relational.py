"""Relational building blocks that the domain operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge, so that "a = x OR b = x" becomes an equi-join."""
    back = edges.select(*(F.col(dst if c == src else src if c == dst else c).alias(c) for c in edges.columns))
    return edges.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) counting both ends of each edge; summed before the shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key. The order must be total for reproducible results."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows that agree in keys, the first by order (a unique column): sums before the shuffle, no sort."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("row"))
    return first.select(*keys, "row.*").select(*df.columns)


def best_duplicate(df: DataFrame, keys: list[str], score: str, position: str) -> DataFrame:
    """Of duplicates the best scored row (ties: the earliest), at the first one's position."""
    rest = [c for c in df.columns if c not in (*keys, position)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(position))).alias("row"), F.min(position).alias(position))
    return best.select(*keys, "row.*", position).select(*df.columns)


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def not_yet_done(items: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Items without a `processed` entry in the ledger; failed ones come again."""
    return items.join(ledger.where(F.col("status") == "processed").select(key), key, "left_anti")


def merge_latest(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: of each key the row of the highest version."""
    both = base.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("row")).select(key, "row.*").select(*both.columns)


def small(df: DataFrame) -> DataFrame:
    """Mark a side for broadcast if its plan is known to be small; else leave the choice to Spark."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) < 1 << 24 else df


def others(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, other, links) of each different value of a group: the least other value, and how many there are. Values without such, and nulls, drop out.

    A group's count and two least values are found before its values meet them, so no
    pairs of a group are made. Values are written once, and each step holds them in one
    aggregate or one sort alone.
    """
    values = settle(rows.where(F.col(value).isNotNull()).select(*group, value).distinct(), "others-values")
    least = values.groupBy(*group).agg(F.min(value).alias("__least"), F.count("*").alias("__all")).where("__all > 1")
    above = values.join(least, group).where(F.col(value) > F.col("__least"))
    second = settle(above.groupBy(*group, "__least", "__all").agg(F.min(value).alias("__second")), "others-seconds")
    other = F.when(F.col(value) == F.col("__least"), F.col("__second")).otherwise(F.col("__least"))
    return values.join(second, group).select(*group, value, other.alias("other"), (F.col("__all") - 1).alias("links"))
