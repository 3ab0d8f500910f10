"""All pairs of vectors above a cosine threshold, without a cross join: cells around pivots, with copies across their borders.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2t). The left
side's vectors lie in the cell of their nearest pivot. A right vector y can have a partner
in the cell of pivot c only if d(y, c) <= r + the cell's radius, and if the plane halfway
between c and y's own nearest pivot is no further than r; it is copied to just these
cells. So no pair is lost, and cells check what they hold exactly, in matrix products.

Cells grow with no group: both sides of a cell are cut into chunks of CHUNK vectors, and
a task holds one chunk of the right side while the left one streams past it. Pivots are a
bounded sample, PIVOTS at most; how many are taken grows with the square root of the table.

Vectors of counts that lie in no clusters are met whole instead (`met_counts`): there cells prune nothing,
and each vector would be copied to most of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle

PIVOTS, CHUNK, BATCH = 256, 4096, 1024
#: Copies of vectors that a task gives at once.
COPIES = 4096
#: Slack for rounding.
EPS = 1e-9
#: Counts of the right side that a task holds, of the left side that stream past them at most and at least, and cosines that are there at once.
BLOCK, STREAM, LEAST, CELLS = 32768, 32768, 2048, 1 << 22


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(vectors: DataFrame) -> DataFrame:
    """(id, v): vectors of length one, by their ids; those without a direction go, having cosine 0 with all."""
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select("id", F.col("v").cast("array<double>").alias("v")).withColumn("n", n).where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def copied(b: pa.RecordBatch, row: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, v, cell) of a batch's rows in their cells, COPIES at a time: all at once would be up to PIVOTS times as large as the batch."""
    for lo in range(0, len(row), COPIES):
        take = pa.array(row[lo : lo + COPIES])
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell[lo : lo + COPIES], pa.int32())], ["id", "v", "cell"])


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(left_id, right_id, cosine) of all pairs of left and right (id, v) with a cosine above the threshold (in (0, 1))."""
    spark = left.sparkSession
    left, right = settle(unit(left), "cosine-left"), settle(unit(right), "cosine-right")
    out = "left_id long, right_id long, cosine double"
    count = left.count()
    some = left.orderBy(F.xxhash64("id"), "id").limit(min(pivots, max(1, ceil(sqrt(count))))).collect()  # bounded by `pivots`
    if not some:
        return spark.createDataFrame([], out)
    centres = np.array([r["v"] for r in some])
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    reach = sqrt(max(2 - 2 * threshold, 0)) + EPS

    def far(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * v @ centres.T, 0))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = far(matrix(b.column(1)))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "d"])

    held = settle(left.mapInArrow(home, "id long, v array<double>, cell int, d double"), "cosine-homes")
    cells = {r["cell"]: (r["radius"], r["n"]) for r in held.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()}  # one a pivot
    radius = np.array([cells.get(c, (-np.inf, 0))[0] for c in range(len(centres))])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = far(matrix(b.column(1)))
            own = d.argmin(axis=1)
            nearest = d[np.arange(len(d)), own][:, None]
            between = apart[own]
            plane = np.divide(d * d - nearest * nearest, 2 * between, out=np.zeros_like(d), where=between > EPS)
            row, cell = np.nonzero((d <= radius + reach) & (plane <= reach))
            yield from copied(b, row, cell)

    asked = settle(right.mapInArrow(visit, "id long, v array<double>, cell int"), "cosine-visits")
    sizes = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    # (cell, chunks of its left side, chunks of its right side)
    parts = spark.createDataFrame([(c, -(-n // chunk), -(-sizes[c] // chunk)) for c, (_, n) in cells.items() if c in sizes], "c int, lefts int, rights int")

    def dealt(side: DataFrame, mine: str, others: str, who: int) -> DataFrame:
        s = side.join(F.broadcast(parts), F.col("cell") == F.col("c"))
        own, all_ = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        s = s.select("cell", own.alias("__own"), all_.alias("__other"), F.lit(who).alias("side"), "id", "v")
        i, j = ("__own", "__other") if who else ("__other", "__own")
        return s.select("cell", F.col(i).alias("i"), F.col(j).alias("j"), "side", "id", "v")

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = dealt(asked.select("id", "v", "cell"), "rights", "lefts", 0).unionAll(dealt(held.select("id", "v", "cell"), "lefts", "rights", 1))
    rows = rows.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, names = None, [], []
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            ids, v = b.column(4).to_numpy(), matrix(b.column(5))
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(cut, cut[1:], strict=False):
                key = tuple(keys[lo, :3])
                if key != now:
                    now, stored, names = key, [], []
                if keys[lo, 3] == 0:
                    stored.append(v[lo:hi])
                    names.append(ids[lo:hi])
                    continue
                if len(stored) > 1:
                    stored, names = [np.concatenate(stored)], [np.concatenate(names)]
                for k in range(lo, hi, BATCH) if stored else ():
                    c = v[k : min(k + BATCH, hi)] @ stored[0].T
                    x, y = np.nonzero(c > threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k + x]), pa.array(names[0][y]), pa.array(c[x, y])], ["left_id", "right_id", "cosine"])

    return rows.mapInArrow(check, out)


class Counts:
    """A block of vectors of counts. Whole numbers' products are exact, in single precision as long as their sums can't pass 2**24."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v, self.norm = ids, {"f4": v.astype("f4")}, norms(v)
        self.most = self.norm.max()
        if self.most >= 1 << 12:  # two such vectors' products may be too large
            self.v["f8"] = v.astype("f8")

    def above(self, v: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first, row, place, cosine) of the pairs of v's rows from `first` on and the block's vectors with a cosine above the threshold, by row."""
        step, norm = max(1, CELLS // len(self.ids)), norms(v)
        for lo in range(0, len(v), step):
            n = norm[lo : lo + step]
            kind = "f4" if n.max() * self.most < 1 << 24 else "f8"
            if kind not in self.v:
                self.v[kind] = self.v["f4"].astype(kind)
            c = v[lo : lo + step].astype(kind) @ self.v[kind].T
            # a little less, as this is rounded
            at = np.flatnonzero(c >= np.multiply.outer((n * (threshold - 1e-6)).astype(kind), self.norm.astype(kind)))
            row, place = np.divmod(at, len(self.ids))
            cosine = c.ravel()[at].astype("f8") / n[row] / self.norm[place]
            hit = np.flatnonzero(cosine > threshold)
            yield lo, row[hit], place[hit], cosine[hit]


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype("f8") ** 2).sum(1))


def pairs_of(ids: np.ndarray, others: np.ndarray, row: np.ndarray, place: np.ndarray, cosine: np.ndarray) -> list[np.ndarray]:
    """(left_id, right_id, cosine): pairs as they are."""
    return [ids[row], others[place], cosine]


def strongest_of(ids: np.ndarray, others: np.ndarray, row: np.ndarray, place: np.ndarray, cosine: np.ndarray) -> list[np.ndarray]:
    """(left_id, right_id, cosine, links): each row's highest cosine, ties to the smaller right_id, and how many there are. Pairs come by row."""
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    links = np.diff(begin, append=len(row))
    most = np.maximum.reduceat(cosine, begin) if len(row) else cosine
    first = np.where(cosine == np.repeat(most, links), others[place], np.iinfo(np.int64).max)
    return [ids[row[begin]], np.minimum.reduceat(first, begin) if len(row) else first, most, links]


def met_counts(left: DataFrame, right: DataFrame, threshold: float, fold: Callable[..., list[np.ndarray]], out: str, shown: Callable[[np.ndarray], np.ndarray] = lambda x: x, block: int = BLOCK, chunk: int = STREAM) -> DataFrame:
    """What `fold` makes (`out`) of the pairs of left and right (cell, id, v: counts, not all 0) of one cell with a cosine above the threshold.

    All pairs of a cell are met, exactly, in matrix products: blocks of the right side lie in a task, and a chunk
    of the left one streams past. fold is given some rows' ids, the block's, and of each pair row, place and cosine, as `shown`.
    Pairs leave a task as they are found, CELLS at most at once. Cells are few.
    """
    spark = left.sparkSession
    count = lambda d: {r["cell"]: r["n"] for r in d.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    lefts, rights = count(left), count(right)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 4
    blocks = {c: -(-n // block) for c, n in rights.items() if c in lefts}
    # few vectors are cut smaller, so that all tasks have some
    size = min(chunk, max(LEAST, -(-sum(lefts[c] * n for c, n in blocks.items()) // tasks)))
    if not blocks:
        return spark.createDataFrame([], out)
    parts = F.broadcast(spark.createDataFrame([(c, -(-lefts[c] // size), n) for c, n in blocks.items()], "cell int, lefts int, rights int"))

    def dealt(side: DataFrame, mine: str, others: str, who: int) -> DataFrame:
        own, all_ = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        s = side.join(parts, "cell").select("cell", own.alias("own"), all_.alias("other"), F.lit(who).alias("side"), "id", "v")
        i, j = ("own", "other") if who else ("other", "own")
        return s.select("cell", F.col(i).alias("i"), F.col(j).alias("j"), "side", "id", "v")

    rows = dealt(right, "rights", "lefts", 0).unionAll(dealt(left, "lefts", "rights", 1)).repartition(tasks, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")
    names = [c.split()[0] for c in out.split(", ")]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, held = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            ids, v = b.column(4).to_numpy(), matrix(b.column(5))
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                key = tuple(keys[lo, :3].tolist())
                if key != now:
                    now, stored, held = key, [], None
                if keys[lo, 3] == 0:
                    stored.append((ids[lo:hi], v[lo:hi]))
                    continue
                if held is None and stored:
                    held, stored = Counts(*(np.concatenate(x) for x in zip(*stored, strict=True))), []
                for first, row, place, cosine in held.above(v[lo:hi], threshold) if held else ():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in fold(ids[lo + first : hi], held.ids, row, place, shown(cosine))], names)

    return rows.mapInArrow(check, out)
