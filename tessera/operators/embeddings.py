"""Layered neighbour embeddings: node vectors, the mean of their neighbours', and a matrix for both, layer upon layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .relational import undirected

Matrix = list[list[float]]


def seeded_features(nodes: DataFrame, dims: int) -> DataFrame:
    """(node, x): for each node (a whole number) `dims` values in [-1, 1) that its number alone determines."""
    return nodes.select("node", F.array(*(((F.col("node") * (k + 3) * 7919 + k * 104729) % 1000) / 500.0 - 1 for k in range(dims))).alias("x"))


def seeded_weights(rows: int, columns: int, seed: int) -> Matrix:
    """A matrix of values in [-1, 1] from a seed."""
    return [[(((r * columns + c) * 37 + seed) % 19 - 9) / 9.0 for c in range(columns)] for r in range(rows)]


def around(edges: DataFrame, x: DataFrame, dims: int) -> DataFrame:
    """(node, m): the mean vector of each node's neighbours, by sums for each dimension that are made before the shuffle."""
    met = undirected(edges.select("src", "dst")).join(x, F.col("dst") == F.col("node"))
    return met.groupBy(F.col("src").alias("node")).agg(F.array(*(F.avg(F.get("x", F.lit(k))) for k in range(dims))).alias("m"))


def layered(edges: DataFrame, features: DataFrame, layers: list[Matrix]) -> DataFrame:
    """(node, x) after all layers; features: (node, x). A layer's matrix has two columns for each dimension it gets: own, then around.

    Negative values become 0 between layers; the last one's vectors have length one (or
    are all zero). A node without neighbours has zeros around it.
    """
    x = settle(features, "embedding-features")
    for n, weights in enumerate(layers):
        dims = len(weights[0]) // 2
        zeros = F.array(*([F.lit(0.0)] * dims))
        both = x.join(around(edges, x, dims), "node", "left").select("node", F.concat("x", F.coalesce("m", zeros)).alias("h"))
        rows = [sum((F.get("h", F.lit(c)) * w for c, w in enumerate(row)), F.lit(0.0)) for row in weights]
        last = n == len(layers) - 1
        y = both.select("node", F.array(*(v if last else F.greatest(v, F.lit(0.0)) for v in rows)).alias("x"))
        if last:
            length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
            y = y.withColumn("__n", length).select("node", F.transform("x", lambda v: F.when(F.col("__n") > 0, v / F.col("__n")).otherwise(F.lit(0.0))).alias("x"))
        x = settle(y, "embedding-layer")
    return x
