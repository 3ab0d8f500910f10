"""A ball tree over points of the Poincaré ball, built and searched level by level as tables.

Build: each node splits its points at the median of the axis of the tangent space at the
origin that varies most, down to leaves of at most `leaf` points (or of equal ones). Every
level is one pass of sums by node, so the root is no bottleneck. A node is a row: centre,
radius (largest distance to the centre), number of points; node n has children 2n, 2n + 1.

Search: a query first goes down to the leaf of the nearer centres; the k-th distance there
bounds the result. Then it descends from the root into every child whose ball can hold a
nearer point (distance to the centre - radius within the bound), and meets the points of
the leaves it reaches. The node table goes to the tasks, which descend for a batch of
queries at once; by default leaves grow with the points, so that a tree has about 2 * LEAVES
nodes at most. Leaves next to each other make up a cell. A query goes once to each cell of
which it reaches a leaf, and meets the points there leaf by leaf, in matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import settle
from .vectors import NEAREST, Nearest, ball_distances, meet, ranked

#: Points of a leaf (more where LEAVES of them wouldn't hold all points), levels, and cells.
LEAF, LEAVES, DEPTH, CELLS = 64, 512, 60, 32
#: Slack for rounded distances.
EPS = 1e-6


@dataclass
class BallTree:
    nodes: DataFrame  #: node, n, centre, radius, is_leaf
    points: DataFrame  #: vec_id, p, leaf (its node)
    depth: int


def build(points: DataFrame, leaf: int | None = None) -> BallTree:
    """The tree of points (vec_id, p); without points it has no nodes. leaf: points of a leaf, LEAF by default and more from LEAF * LEAVES points on."""
    rows = settle(points.select("vec_id", "p", G.log0(F.col("p")).alias("t"), F.lit(1).cast("long").alias("node")), "ball-points")
    leaf = leaf or max(LEAF, -(-rows.count() // LEAVES))
    first = rows.select(F.size("p")).first()
    dims = first[0] if first else 0
    nodes, leaves, depth = None, None, 0
    for depth in range(DEPTH):
        each = lambda f, c: F.array(*(f(F.get(c, F.lit(k))) for k in range(dims))) if dims else F.array().cast("array<double>")
        stats = settle(rows.groupBy("node").agg(F.count("*").alias("n"), each(F.avg, "p").alias("centre"), each(F.var_pop, "t").alias("spread")), "ball-stats")
        axis = (F.array_position("spread", F.array_max("spread")) - 1).cast("int")
        splits = (F.col("n") > leaf) & (F.array_max("spread") > 0) if depth < DEPTH - 1 else F.lit(False)
        known = stats.select("node", "n", "centre", splits.alias("splits"), axis.alias("axis"))
        met = rows.join(known, "node")
        x = F.get("t", F.col("axis"))
        sums = met.groupBy("node").agg(F.max(G.distance(F.col("p"), F.col("centre"))).alias("radius"), F.percentile_approx(x, 0.5, 1000).alias("cut"), F.max(x).alias("top"))
        level = settle(known.join(sums, "node"), "ball-level")
        own = level.select("node", "n", "centre", "radius", (~F.col("splits")).alias("is_leaf"))
        nodes = own if nodes is None else nodes.unionAll(own)
        dealt = rows.join(level.select("node", "splits", "axis", "cut", "top"), "node")
        done = dealt.where("NOT splits").select("vec_id", "p", F.col("node").alias("leaf"))
        leaves = done if leaves is None else leaves.unionAll(done)
        # at most half lies beyond the median; where the median is the largest value, what has it goes right
        right = (x > F.col("cut")) | ((F.col("cut") == F.col("top")) & (x == F.col("top")))
        rows = settle(dealt.where("splits").select("vec_id", "p", "t", (2 * F.col("node") + right.cast("long")).alias("node")), "ball-points")
        if rows.isEmpty():
            break
    return BallTree(settle(nodes, "ball-nodes"), settle(leaves, "ball-leaves"), depth + 1)


class Nodes:
    """The node table in a task, by rows in the order of node numbers: a parent comes before its children."""

    def __init__(self, tree: BallTree):
        rows = sorted(tree.nodes.collect(), key=lambda r: r["node"])  # about 2 * LEAVES
        self.node = np.array([r["node"] for r in rows], np.int64)
        self.centre, self.radius = np.array([r["centre"] for r in rows]), np.array([r["radius"] for r in rows])
        self.leaf = np.array([r["is_leaf"] for r in rows], bool)
        place = {n: k for k, n in enumerate(self.node.tolist())}
        self.left, self.right = (np.array([-1 if f else place[2 * n + side] for n, f in zip(self.node.tolist(), self.leaf, strict=True)]) for side in (0, 1))
        # leaves from left to right, cut into cells that hold about as many points each
        order, stack = [], [0] if rows else []
        while stack:
            k = stack.pop()
            if self.leaf[k]:
                order.append(k)
            else:
                stack += [self.right[k], self.left[k]]
        sizes = np.array([rows[k]["n"] for k in order], float)
        self.cell = np.full(len(rows), -1)
        self.cell[order] = ((np.cumsum(sizes) - sizes) * CELLS // max(sizes.sum(), 1)).astype(int)

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf of the nearer centres for each query."""
        far, at = ball_distances(q, self.centre), np.zeros(len(q), np.int64)
        rows = np.arange(len(q))
        while (inner := ~self.leaf[at]).any():
            left, right = self.left[at], self.right[at]
            at = np.where(inner, np.where(far[rows, left] <= far[rows, right], left, right), at)
        return at

    def reached(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """(queries x nodes): whether a query descends to a node."""
        can = ball_distances(q, self.centre) - self.radius <= bound[:, None] + EPS
        if len(self.node):
            can[:, 0] = True
        for k in np.flatnonzero(~self.leaf):
            for child in (self.left[k], self.right[k]):
                can[:, child] &= can[:, k]
        return can


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, dims))


def _bounds(tree: BallTree, nodes: Nodes, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, q) with x, the k-th distance in their own leaf (null: it has fewer others); and the points by cells, with their leaf's row as tag."""
    dims = nodes.centre.shape[1] if len(nodes.node) else 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = nodes.home(_matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.cell[at], pa.int32()), b.column(0), b.column(1), pa.array(at.astype(float))], ["cell", "query_id", "q", "x"])

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(nodes.node, b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.cell[at], pa.int32()), pa.array(at, pa.int32()), b.column(0), b.column(1)], ["cell", "tag", "vec_id", "p"])

    asked = settle(queries.select("query_id", "q").mapInArrow(place, "cell int, query_id long, q array<double>, x double"), "ball-home")
    held = settle(tree.points.select("vec_id", "p", "leaf").mapInArrow(tagged, "cell int, tag int, vec_id long, p array<double>"), "ball-held")
    own = lambda _, ids, q, x: Nearest(ids, q, k, open_=x[:, None] == np.arange(len(nodes.node)))
    found = ranked(meet(asked, held, own, NEAREST), k).where(F.col("rank") == k).select("query_id", F.col("d").alias("x"))
    return settle(asked.select("query_id", "q").join(found, "query_id", "left"), "ball-bounds"), held


def _bound(column: pa.Array | np.ndarray) -> np.ndarray:
    x = column if isinstance(column, np.ndarray) else column.to_numpy(zero_copy_only=False)
    return np.nan_to_num(x.astype(float), nan=np.inf)


def visits(tree: BallTree, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, q, node, is_leaf): the nodes that each query (query_id, q) has to look at for its k nearest."""
    nodes = Nodes(tree)
    asked, _ = _bounds(tree, nodes, queries, k)
    dims = nodes.centre.shape[1] if len(nodes.node) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at = np.nonzero(nodes.reached(_matrix(b.column(1), dims), _bound(b.column(2))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(nodes.node[at]), pa.array(nodes.leaf[at])], ["query_id", "q", "node", "is_leaf"])

    return asked.select("query_id", "q", "x").mapInArrow(run, "query_id long, q array<double>, node long, is_leaf boolean")


def search(tree: BallTree, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest points of each query other than itself: query_id, vec_id, d, rank (ties to the smaller vec_id)."""
    nodes = Nodes(tree)
    if not len(nodes.node):
        return queries.sparkSession.createDataFrame([], f"{NEAREST}, rank int")
    asked, held = _bounds(tree, nodes, queries, k)
    dims = nodes.centre.shape[1]
    leaves = np.flatnonzero(nodes.leaf)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            can, met = nodes.reached(_matrix(b.column(1), dims), _bound(b.column(2))), np.zeros((b.num_rows, CELLS), bool)
            for at in leaves:
                met[:, nodes.cell[at]] |= can[:, at]
            row, cell = np.nonzero(met)
            for lo in range(0, len(row), 8192):  # a batch of queries in all their cells would be CELLS times as large
                take = pa.array(row[lo : lo + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(cell[lo : lo + 8192], pa.int32()), *(b.column(j).take(take) for j in range(3))], ["cell", "query_id", "q", "x"])

    front = settle(asked.select("query_id", "q", "x").mapInArrow(cells, "cell int, query_id long, q array<double>, x double"), "ball-front")
    return ranked(meet(front, held, lambda _, ids, q, x: Nearest(ids, q, k, open_=nodes.reached(q, _bound(x))), NEAREST), k)


def similarity(d: Column) -> Column:
    """What a search's score is made of: 1 / (1 + distance)."""
    return G.similarity(d)
