"""Projections onto cones of ordered shapes, and a greedy choice of points far from one another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dykstra

Projection = Callable[[np.ndarray], np.ndarray]


def half_space(places: list[int], signs: list[float]) -> Projection:
    """Onto the vectors whose values at `places`, weighed by `signs`, sum to 0 or more."""
    at, s = np.array(places), np.array(signs, float)

    def project(y: np.ndarray) -> np.ndarray:
        short = float(y[at] @ s)
        if short >= 0:
            return y
        out = y.copy()
        out[at] -= short * s / (s @ s)
        return out

    return project


def edgeworth(grid: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The nearest grid in which moving on in rows and in columns strengthen each other: no 2 x 2 cell's g[1,1] - g[1,0] - g[0,1] + g[0,0] is below 0."""
    rows, columns = grid.shape
    at = lambda r, c: r * columns + c
    cells = [half_space([at(r + 1, c + 1), at(r + 1, c), at(r, c + 1), at(r, c)], [1, -1, -1, 1]) for r in range(rows - 1) for c in range(columns - 1)]
    return dykstra(grid.astype(float).ravel(), cells, rounds).reshape(grid.shape)


def dominance(p: np.ndarray, q: np.ndarray, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pair of vectors in which p rises at least as much as q from each place to the next."""
    n = len(p)
    steps = [half_space([t + 1, t, n + t + 1, n + t], [1, -1, -1, 1]) for t in range(n - 1)]
    both = dykstra(np.concatenate([p, q]).astype(float), steps, rounds)
    return both[:n], both[n:]


def far_points(points: DataFrame, k: int, distances: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(rank, vec_id, d): greedy k-centre of points (vec_id, p), from the smallest id on: each next point is the one furthest from all before it, at distance d.

    A pass a point: tasks give their best, and the best of these is taken (ties to the
    smaller id). The driver holds the k points that are chosen.
    """
    start = points.agg(F.min_by(F.struct("vec_id", "p"), "vec_id")).first()
    chosen: list[tuple[int, list[float], float]] = []
    if start and start[0]:
        chosen.append((start[0]["vec_id"], start[0]["p"], 0.0))
    while chosen and len(chosen) < k:
        centres = np.array([p for _, p, _ in chosen])

        def best(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            found: tuple[float, int, list[float]] | None = None
            for b in batches:
                if b.num_rows:
                    p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    ids, d = b.column(0).to_numpy(), distances(centres, p).min(axis=0)
                    i = int(np.lexsort((ids, -d))[0])
                    if found is None or (-d[i], ids[i]) < (-found[0], found[1]):
                        found = (float(d[i]), int(ids[i]), p[i].tolist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([found[1]]), pa.array([found[0]]), pa.array([found[2]])], ["vec_id", "d", "p"])

        got = points.select("vec_id", "p").mapInArrow(best, "vec_id long, d double, p array<double>").agg(F.min_by(F.struct("vec_id", "d", "p"), F.struct(-F.col("d"), "vec_id"))).first()[0]
        if got["vec_id"] in {i for i, _, _ in chosen}:  # there are no more points
            break
        chosen.append((got["vec_id"], got["p"], got["d"]))
    return points.sparkSession.createDataFrame([(n + 1, i, d) for n, (i, _, d) in enumerate(chosen)], "rank int, vec_id long, d double")
