"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees end to end. Node n of a tree sends a row left if its feature is at most cut[n]; leaves point to themselves."""

    feature: np.ndarray  # int32
    cut: np.ndarray  # float64
    left: np.ndarray  # int32, absolute
    right: np.ndarray
    value: np.ndarray  # float64, used at leaves
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x, all trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: int = 8
) -> FlatTrees:
    """Fit on rows x and labels y (0/1). monotone: per feature 1 (never falls), -1 (never rises) or 0.

    Defined results: no rows, or one label only, give no trees and that label's log-odds.
    """
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def done(depth: int) -> FlatTrees:
        return FlatTrees(np.array(feature, "i4"), np.array(cut, "f8"), np.array(left, "i4"), np.array(right, "i4"), np.array(value, "f8"), np.array(roots, "i4"), depth, base)

    if n == 0 or y.min() == y.max():
        return done(0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(feature))
        todo = [(np.arange(n), depth, -np.inf, np.inf)]
        places = [roots[-1]]
        for a in (feature, cut, left, right, value):
            a.append(0)
        while todo:
            rows, levels, low, high = todo.pop()
            place = places.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            if levels and len(rows) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = code[rows, j]
                    gl = np.cumsum(np.bincount(k, grad[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(k, hess[rows], len(e) + 1))[:-1]
                    cl = np.cumsum(np.bincount(k, minlength=len(e) + 1))[:-1]
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                    gain = gl * vl - 0.5 * (hl + ridge) * vl**2 + (g - gl) * vr - 0.5 * (h - hl + ridge) * vr**2
                    bad = (cl < least) | (len(rows) - cl < least) | ((vr - vl) * monotone[j] < 0)
                    gain = np.where(bad, -np.inf, gain)
                    b = int(np.argmax(gain))
                    if np.isfinite(gain[b]) and (best is None or gain[b] > best[0]):
                        best = (gain[b], j, b, vl[b], vr[b])
            own = float(np.clip(g / (h + ridge), low, high))
            if best is None or best[0] <= g * own - 0.5 * (h + ridge) * own**2 + 1e-9:
                left[place] = right[place] = place
                value[place] = rate * own
                margin[rows] += rate * own
                continue
            _, j, b, vl, vr = best
            feature[place], cut[place] = j, float(edges[j][b])
            goes = code[rows, j] <= b
            # children on either side of a constrained split may not cross its middle
            mid = (vl + vr) / 2
            spans = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[j])]
            for side, sub, (lo, hi) in ((left, rows[goes], spans[0]), (right, rows[~goes], spans[1])):
                side[place] = len(feature)
                places.append(len(feature))
                for a in (feature, cut, left, right, value):
                    a.append(0)
                todo.append((sub, levels - 1, lo, hi))
    return done(depth)
