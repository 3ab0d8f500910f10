"""Exact top-k inner products over an impact-ordered index, score at a time.

Components become integers floor(SCALE * x), their impacts. Candidates are dealt
evenly into blocks of BLOCK vectors. A block's postings stand by dimension and, within
it, by impact: a segment is the run of vectors that have one impact in one dimension.

A query meets a block's segments in the order of what they add, |q * impact|, in
rounds that end at falling limits t (ROUNDS, as shares of the usual size of such a
product). Postings are accumulated; a vector's score so far is held together with the
number of its postings that are in. Each posting still to come adds less than t, so

    bound = score so far + postings to come * (t - 1)

is what a vector can reach at most. The query stops at a block when the k-th best exact
score found so far proves that few of its vectors (FEW) can still be members: those
with bound >= that score, ties included, are rescored exactly. A query that no round
settles has taken all postings, and rescores what reaches that score.

Scale: one task holds one or more cells (runs of blocks) of the index and brings the
best k of each query from block to block. Queries come in passes of PASS, each written
on its own, so that a pass moves the index once, and the disk and memory it takes are
bounded: a task holds one block, and the queries of one pass with their best k.

Defined results: null vectors and those with null or non-finite components take no
part. Vectors of different lengths meet as if filled up with zeros. Rows with the
query's vec_id are its own, never its neighbours; rows of other repeated ids each
count. Repeated query rows answer once. Fewer candidates than k: all of them. Ties go
to the smaller vec_id. An empty table, or one without queries, gives no rows. Other
columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, load, new_path

SCALE, K, BLOCK = 64, 20, 16384
#: Queries of a pass, and of a row of packed queries.
PASS, BATCH = 1 << 16, 1 << 11
#: Blocks of a cell at most.
CELL = 32
#: Limits of the rounds, as shares of a query's and a block's root mean square product; the last one takes all.
ROUNDS = (0.4, 0.2, 0.1, 0.0)
#: A query is settled at a block if at most this share of its vectors can still be members.
FEW = 0.15
#: Sums below this are exact in doubles.
EXACT = 1 << 52
NONE = np.iinfo(np.int64).min


def impacts(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, key) of the vectors that take part: integer impacts, and a hash of the row."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ok = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return ok.select("vec_id", v.alias("v")).withColumn("key", F.xxhash64("vec_id", "v"))


PACKED = ["g", "ids", "keys", "x", "width", "type"]
PACKED_TYPE = "g long, ids binary, keys binary, x binary, width int, type string"


def packed(rows: DataFrame, most: int) -> DataFrame:
    """One row for each `most` vectors of (g, vec_id, key, v), which stand together by g in a partition: ids, keys, the matrix and its width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            ids, keys = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            sizes, flat = (np.concatenate([h[i] for h in held]) for i in (2, 3))
            width = int(sizes.max(initial=0))
            x = np.zeros((len(ids), width), np.int64)
            x[np.arange(width)[None, :] < sizes[:, None]] = flat
            peak = int(np.abs(x).max(initial=0))
            kind = "i1" if peak < 1 << 7 else "<i2" if peak < 1 << 15 else "<i8"
            cols = [pa.array([at], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids.astype("<i8"), keys.astype("<i8"), x.astype(kind))), pa.array([width], pa.int32()), pa.array([kind])]
            return pa.RecordBatch.from_arrays(cols, PACKED)

        for b in batches:
            g, ids, keys = (b.column(i).to_numpy() for i in range(3))
            v = b.column(3)
            sizes, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            a = 0
            while a < len(ids):
                if at is not None and (g[a] != at or size == most):
                    if held:
                        yield out()
                    held, size = [], 0
                at = int(g[a])
                other = np.flatnonzero(g[a:] != at)
                z = min(a + most - size, a + int(other[0]) if len(other) else len(ids))
                held.append((ids[a:z], keys[a:z], sizes[a:z], flat[ends[a] : ends[z]]))
                size += z - a
                a = z
        if held:
            yield out()

    return rows.select("g", "vec_id", "key", "v").mapInArrow(run, PACKED_TYPE)


@dataclass
class Block:
    """Vectors, and their postings in segments: (dimension, impact) and the run of places in `post` that have it."""

    ids: np.ndarray
    x: np.ndarray
    post: np.ndarray
    dim: np.ndarray
    impact: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    held: np.ndarray  # postings of each vector
    exact: np.ndarray  # x as doubles


def index(ids: np.ndarray, x: np.ndarray) -> Block:
    n, width = x.shape
    order = np.argsort(-x, axis=0, kind="stable").T  # by dimension, falling impact
    level = np.take_along_axis(x.T, order, axis=1)
    new = np.ones((width, n), bool)
    new[:, 1:] = level[:, 1:] != level[:, :-1]
    dim, place = np.nonzero(new)
    begin = dim * n + place
    size = np.diff(np.concatenate([begin, [n * width]]))
    impact = level[dim, place]
    some = impact != 0  # zero adds nothing: no posting
    return Block(ids, x, order.ravel(), dim[some], impact[some], begin[some], size[some], (x != 0).sum(axis=1), x.astype(np.float64))


class Best:
    """The best k of each query so far: higher scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], scores]), np.concatenate([self.id[q], ids])
        order = np.lexsort((i, ~s))[: self.score.shape[1]]  # ~s falls as s grows, and doesn't overflow
        self.score[q], self.id[q] = s[order], i[order]


def search(q: np.ndarray, qids: np.ndarray, block: Block, best: Best, tally: Counter | None = None) -> None:
    """Bring one block into the best of each query.

    tally counts queries met, those stopped by proof (before all postings were in), postings there and taken, and vectors rescored.
    """
    n, width, k = *block.x.shape, best.score.shape[1]
    tally = Counter() if tally is None else tally
    q = np.pad(q, ((0, 0), (0, max(0, width - q.shape[1]))))[:, :width]
    low = 1 << width.bit_length()  # the digits below it count postings
    there = block.x != 0
    big, usual = float(np.abs(block.x.astype("f8")).max(initial=0)), float(np.sqrt(np.mean(block.exact**2))) if block.x.size else 0.0
    for r, own in enumerate(qids):
        tally["queries"] += 1
        v = q[r].astype("f8")
        if np.abs(v).sum() * big * low >= EXACT:  # sums may not be exact in doubles: every vector is a possible member
            at = np.flatnonzero(block.ids != own)
            best.add(r, block.x[at] @ q[r], block.ids[at])
            tally["rescored"] += len(at)
            continue
        adds = v[block.dim] * block.impact
        size = np.abs(adds)
        come = there[:, v != 0].sum(axis=1) if (v == 0).any() else block.held
        scale = usual * float(np.sqrt(np.mean(v**2))) if width else 0.0
        tally["postings"] += int(block.size[size > 0].sum())
        got, upper = np.zeros(n), np.inf
        for share in ROUNDS:
            limit = max(1.0, np.ceil(share * scale))
            some = np.flatnonzero((size >= limit) & (size < upper))
            upper = min(upper, limit)
            if len(some):
                runs = block.size[some]
                # segments that follow one another in the list are one stretch of it
                cuts = np.flatnonzero(np.diff(block.begin[some]) != runs[:-1])
                first, last = block.begin[some[np.concatenate([[0], cuts + 1])]], (block.begin[some] + runs)[np.concatenate([cuts, [len(some) - 1]])]
                vectors = np.concatenate([block.post[a:z] for a, z in zip(first.tolist(), last.tolist(), strict=True)])
                # a posting adds its score, and 1 to the low digits
                got += np.bincount(vectors, np.repeat(adds[some] * low + 1.0, runs), n)
                tally["taken"] += len(vectors)
            score = np.floor(got / low)
            bound = score + (come - (got - score * low)) * (upper - 1)
            floor = best.score[r, -1]
            if floor == NONE and n > k:  # k real candidates prove a first floor
                top = np.argpartition(-score, k)[: k + 1]
                top = top[block.ids[top] != own]
                if len(top) >= k:
                    floor = np.sort(block.exact[top] @ v)[-k]
            member = np.flatnonzero((bound >= floor) & (block.ids != own))
            if upper == 1 or len(member) <= max(FEW * n, 2 * k):
                tally["stopped"] += upper > 1
                tally["rescored"] += len(member)
                best.add(r, (block.exact[member] @ v).astype(np.int64), block.ids[member])
                break


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows in `parts` even groups g (round robin, so no key matters), each of one partition."""
    return rows.repartition(parts).withColumn("g", F.spark_partition_id().cast("long"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, in_pass: int = PASS) -> DataFrame:
    """(query_id, rank, vec_id, score) for durable tables of impacts (vec_id, v, key)."""
    spark = candidates.sparkSession
    n, asked = candidates.count(), durable(queries.dropDuplicates(["vec_id", "v"]), "topk-queries")
    passes = -(-asked.count() // in_pass)
    # cells of at most CELL blocks, and enough of them for all cores
    cells = max(1, -(-n // (block * CELL)), min(-(-n // 1024), spark.sparkContext.defaultParallelism))
    blocks = durable(packed(dealt(candidates, cells), block), "topk-index")
    asked = durable(packed(dealt(asked, max(1, passes)), min(BATCH, in_pass)), "topk-asked")
    path, none = new_path(spark, "topk-best"), "query_id long, rank int, vec_id long, score long"
    for p in range(passes):
        to_all = asked.where(F.col("g") == p).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        rows = to_all.withColumn("indexed", F.lit(False)).unionByName(blocks.withColumn("cell", F.col("g").cast("int")).withColumn("indexed", F.lit(True)))
        grid = rows.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "indexed", F.xxhash64("keys"))
        found = grid.select("indexed", "ids", "keys", "x", "width", "type").mapInArrow(lambda got: search_cell(got, k), "query_id long, qkey long, vec_id long, score long")
        w = Window.partitionBy("query_id", "qkey").orderBy(F.col("score").desc(), "vec_id")
        best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best.write.mode("append").parquet(path)
    return spark.read.schema(none).parquet(path) if passes else spark.createDataFrame([], none)


def search_cell(got: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A pass's queries, then the blocks of a cell; gives the best k of each query there."""
    asked, best, q, qids, qkeys = [], None, None, None, None
    for b in got:
        for n in range(b.num_rows):
            r = {name: b.column(i)[n].as_py() for i, name in enumerate(b.schema.names)}
            ids, keys = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["keys"], "<i8")
            x = np.frombuffer(r["x"], r["type"]).reshape(len(ids), r["width"]).astype(np.int64)
            if not r["indexed"]:
                asked.append((ids, keys, x))
                continue
            if best is None and asked:
                width = max(a[2].shape[1] for a in asked)
                qids, qkeys = (np.concatenate([a[i] for a in asked]) for i in (0, 1))
                q = np.concatenate([np.pad(a[2], ((0, 0), (0, width - a[2].shape[1]))) for a in asked])
                best = Best(len(q), k)
            if best is not None:
                search(q, qids, index(ids, x), best)
    for a in range(0, len(qids) if best is not None else 0, 4096):
        part = best.score[a : a + 4096]
        r, c = np.nonzero(part != NONE)
        r += a
        yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(qkeys[r]), pa.array(best.id[r, c]), pa.array(best.score[r, c])], ["query_id", "qkey", "vec_id", "score"])


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(impacts(load(spark, sf_dir, "embeddings")), "topk-impacts")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
