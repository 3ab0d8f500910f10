"""A gate that is trained where the rows are: logistic weights by proximal gradient steps.

Each step is one pass: tasks sum their rows' gradients and losses, the sums are added up
before they reach the driver, and the driver takes the step: against the gradient, then
towards zero by the penalties (soft thresholds), so that weights become zero exactly. The
bias has no penalty; weights outside `anchored` have an extra one.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle


def primes(most: int) -> list[int]:
    return [n for n in range(2, most + 1) if all(n % d for d in range(2, int(n**0.5) + 1))]


def soft_threshold(x: np.ndarray, t: np.ndarray | float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over rows of the log loss's gradient (bias first) and of the loss."""
    z = x @ w[1:] + w[0]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    off = p - y
    return np.concatenate([[off.sum()], off @ x]), float((np.logaddexp(0, z) - y * z).sum())


def proximal_step(w: np.ndarray, slope: np.ndarray, rate: float, penalty: float, extra: float, anchored: Collection[int]) -> np.ndarray:
    """Weights after one step; weight k of 1.. is w[k], and those not `anchored` have the extra penalty."""
    t = np.array([penalty + (0.0 if k in anchored else extra) for k in range(1, len(w))])
    moved = w - rate * slope
    return np.concatenate([moved[:1], soft_threshold(moved[1:], rate * t)])


def train(rows: DataFrame, steps: int = 30, rate: float = 0.5, penalty: float = 0.0, extra: float = 0.0, anchored: Collection[int] | None = None) -> tuple[np.ndarray, list[float]]:
    """(weights, mean loss before each step and at the end) of rows (x: features, y: 0 or 1). Without rows: no weights."""
    held = settle(rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")), "gate-rows")
    first = held.select(F.size("x")).first()
    if not first:
        return np.zeros(0), []
    width = first[0] + 1
    anchored = primes(width) if anchored is None else anchored
    w, history = np.zeros(width), []
    for step in range(steps + 1):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            g, loss, n = np.zeros(width), 0.0, 0
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    more, lost = gradient(x, b.column(1).to_numpy(zero_copy_only=False), w)
                    g, loss, n = g + more, loss + lost, n + b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([g.tolist()]), pa.array([loss]), pa.array([n])], ["g", "loss", "n"])

        got = held.mapInArrow(sums, "g array<double>, loss double, n long").agg(F.sum("n"), F.sum("loss"), *(F.sum(F.get("g", F.lit(k))) for k in range(width))).first()
        history.append(got[1] / got[0])
        if step < steps:
            w = proximal_step(w, np.array(got[2:]) / got[0], rate, penalty, extra, anchored)
    return w, history
