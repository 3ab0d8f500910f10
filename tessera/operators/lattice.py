"""Routing over E8 cells: vectors of any length are folded to eight coordinates, and cells are the lattice points nearest to them.

Folding turns a vector by a seeded orthogonal matrix and adds its blocks of eight up, so
all coordinates count. A cell's key is twice its lattice point, whole numbers joined by
commas. Lattice points within a distance r of a query differ from the query's own point by
short lattice vectors; routing asks for occupied cells by equi-joins, shell after shell of
these (the 240 shortest, then the 2160 next), and only queries for which these hold fewer
than k cells meet the table of cells at large, in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .blocks import e8_nearest, rotation
from .vectors import met

SCALE, SEED = 4.0, 7


def folded(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """Rows of eight coordinates from rows of any length."""
    width = -(-x.shape[1] // 8) * 8
    turned = np.pad(x, ((0, 0), (0, width - x.shape[1]))) @ rotation(width, SEED).T
    return turned.reshape(len(x), -1, 8).sum(axis=1) / np.sqrt(width // 8) * scale


def shells() -> np.ndarray:
    """The lattice vectors of squared length 0, 2 and 4: 1 + 240 + 2160."""
    out = [np.zeros(8)]
    for places in itertools.combinations(range(8), 2):
        for signs in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[list(places)] = signs
            out.append(v)
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    for k, sign in itertools.product(range(8), (2, -2)):
        v = np.zeros(8)
        v[k] = sign
        out.append(v)
    for places in itertools.combinations(range(8), 4):
        for signs in itertools.product((1, -1), repeat=4):
            v = np.zeros(8)
            v[list(places)] = signs
            out.append(v)
    for k in range(8):  # one coordinate of 3/2, the rest of 1/2, with an even sum
        for s in itertools.product((1, -1), repeat=8):
            v = np.array(s) / 2
            v[k] *= 3
            if round(v.sum()) % 2 == 0:
                out.append(v)
    return np.array(out + halves)


def key(points: np.ndarray) -> list[str]:
    return [",".join(f"{2 * c:.0f}" for c in r) for r in points]


def lattice_cells(vectors: DataFrame) -> DataFrame:
    """(vec_id, y, cell) of vectors (vec_id, v): folded, and the key of the nearest lattice point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                y = folded(np.stack(b["v"].to_numpy()))
                yield pd.DataFrame({"vec_id": b["vec_id"], "y": list(y), "cell": key(e8_nearest(y))})

    return vectors.select("vec_id", "v").mapInPandas(run, "vec_id long, y array<double>, cell string")


def route_cells(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, cell, n, d): the k occupied cells whose lattice points are nearest to each query (ties to the smaller key), from queries and vectors (vec_id, v)."""
    cells = settle(lattice_cells(vectors).groupBy("cell").agg(F.count("*").alias("n")), "lattice-cells")
    asked = settle(lattice_cells(queries).select(F.col("vec_id").alias("query_id"), "y", F.col("cell").alias("home")), "lattice-queries")
    near = shells()
    # a lattice point that isn't in the shells is at least sqrt(6) from the query's own, which is at most 1 from the query
    sure = np.sqrt(6) - 1

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, y in zip(b["query_id"], b["y"], strict=True):
                points = e8_nearest(np.asarray(y)[None, :]) + near
                d = np.sqrt(((points - y) ** 2).sum(axis=1))
                keep = d <= sure
                yield pd.DataFrame({"query_id": q, "cell": key(points[keep]), "d": d[keep]})

    w = Window.partitionBy("query_id").orderBy(F.round("d", 9), "cell")
    best = lambda met: met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found = settle(best(asked.select("query_id", "y").mapInPandas(around, "query_id long, cell string, d double").join(cells, "cell")), "lattice-near")
    full = found.groupBy("query_id").agg(F.count("*").alias("got")).where(F.col("got") >= k).select("query_id")
    rest = asked.join(full, "query_id", "left_anti").select("query_id", "y")
    point = F.transform(F.split("cell", ","), lambda c: c.cast("double") / 2)
    gap = F.aggregate(F.zip_with("y", "point", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    far = best(met(rest, cells.withColumns({"point": point, "vec_id": F.xxhash64("cell")})).select("query_id", "cell", F.sqrt(gap).alias("d"), "n"))
    columns = ["query_id", "rank", "cell", "n", F.round("d", 6).alias("d")]
    return found.join(full, "query_id", "left_semi").select(*columns).unionAll(far.select(*columns))
