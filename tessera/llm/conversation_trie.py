"""Prefix trie of conversations by an external mergesort that carries LCPs.

A conversation is the sequence of its turns. A node of the trie is a distinct sequence of
first turns, a member of a node a conversation that starts with it.

 1. Turns become units of UNIT bytes, a digest of (role, text) and the number of code
    points of text, so a conversation is one byte string whose order is that of its units:
    texts are read once and never shuffled.
 2. Runs. Each task sorts its conversations in runs of at most RUN_BYTES and writes them,
    each with its LCP, the number of first turns that it shares with the one before it.
 3. Cells. The runs are dealt by ranges of (sequence, conversation), so a hot first turn or
    a hot group of copies spreads over as many cells as it fills. A cell gets a piece of
    each run, and the last sequence before it and the first one after it.
 4. Merge. A loser tree merges a cell's pieces. A player keeps its LCP with the last winner:
    the larger LCP wins unseen, equal ones compare only turns beyond them, so shared turns
    are not compared again.
 5. Nodes. The path to the current conversation stands on a stack. The LCP of the next one
    says how much of it stays open; what is closed is finished, adds its sums to its parent
    and leaves once the parent knows its smallest member.
 6. Seams. Nodes that neighbouring cells share (they hold the neighbour's sequence) leave
    with partial sums, which add up: a node counts as its parent's child in the cell that
    meets it first, as a leaf in the one that meets it last. Member lists leave in parts, in
    order, and are digested as they stream by.

Memory: a task holds a cell (about CELL_BYTES), or a run. A conversation is a row of 20
bytes a turn; its turns meet in one task.

Defined results: a null role or text is empty, a null turn comes first; turns of equal
number are in the order of their digests; repeated rows are turns of their own. Rows
without a conv_id take no part. Conversations without turns are members of the root. An
empty table gives no rows, not even a root. Long texts are digested whole. Other columns
are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import durable, load, partitions

DIGEST, SIZE = 16, 4
UNIT = DIGEST + SIZE
#: Bytes of units in a run, and about that many in a cell.
RUN_BYTES, CELL_BYTES = 1 << 25, 1 << 24
#: Members of a shared node in one row of its list.
PART = 4096
BATCH = 8192

Item = tuple[bytes, int, int]  # sequence, conversation, LCP with the item before it in its run


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Number of first units that a and b share; the first `known` are."""
    i, most = known * UNIT, min(len(a), len(b))
    while i < most and a[i : i + UNIT] == b[i : i + UNIT]:
        i += UNIT
    return i // UNIT


def sorted_run(rows: list[tuple[bytes, int]]) -> list[Item]:
    rows.sort()
    return [(s, c, common(rows[i - 1][0], s) if i else 0) for i, (s, c) in enumerate(rows)]


class LoserTree:
    """Merges sorted pieces; `compared` counts units that were looked at."""

    def __init__(self, pieces: list[list[Item]]):
        self.pieces, self.k = pieces, len(pieces)
        self.at = [0] * self.k
        self.shared = [0 if p else -1 for p in pieces]  # LCP with the last winner; -1: nothing is left
        self.losers = [0] * self.k
        self.compared = 0

    def beats(self, a: int, b: int) -> bool:
        """Whether the current item of a comes before that of b; the loser's LCP is then its LCP with the winner."""
        x, y = self.shared[a], self.shared[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        s, c, _ = self.pieces[a][self.at[a]]
        t, d, _ = self.pieces[b][self.at[b]]
        l = common(s, t, x)
        self.compared += l - x + 1
        i = l * UNIT
        first = (s[i : i + UNIT], c) < (t[i : i + UNIT], d)
        self.shared[b if first else a] = l
        return first

    def __iter__(self) -> Iterator[Item]:
        if not self.k:
            return
        k, winners = self.k, [0] * self.k + list(range(self.k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        best = winners[1] if k > 1 else 0
        while self.shared[best] >= 0:
            piece, i = self.pieces[best], self.at[best]
            yield piece[i][0], piece[i][1], self.shared[best]
            self.at[best] = i + 1
            self.shared[best] = piece[i + 1][2] if i + 1 < len(piece) else -1
            node = (best + k) // 2
            while node:
                other = self.losers[node]
                if not self.beats(best, other):
                    best, self.losers[node] = other, best
                node //= 2


NODE = "depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
#: kind 0: a finished node; 1: a cell's part of a shared node; 2: a part of a shared node's member list.
OUT = f"kind int, {NODE}, parent_conv_id long, ends_sha256 string, key binary, parent binary, cell int, part long, ids string"


class Open:
    """A node on the path to the current conversation."""

    __slots__ = ("chars", "convs", "depth", "ends", "goes_on", "ids", "inner", "kids", "leaves", "n_kids", "new", "parts", "prefix", "saved", "smallest")

    def __init__(self, depth: int, prefix: bytes, before: int, after: int):
        self.depth, self.prefix = depth, prefix
        self.new, self.goes_on = depth > before, depth <= after
        self.chars = int.from_bytes(prefix[-SIZE:], "big") if depth else 0
        self.convs = self.n_kids = self.leaves = self.saved = self.parts = 0
        self.smallest: int | None = None
        self.inner = False
        self.ends: Any = None
        self.ids: list[int] = []
        self.kids: list[dict[str, Any]] = []

    @property
    def shared(self) -> bool:
        return self.goes_on or not self.new

    @property
    def key(self) -> bytes:
        return hashlib.sha256(self.prefix).digest()[:DIGEST]


def finished_nodes(items: Iterable[Item], cell: int, last: bytes | None, following: bytes | None) -> Iterator[dict[str, Any]]:
    """Rows of OUT for a cell's merged items; last: the sequence before the cell's first, following: that after its last (None: there is none)."""
    path: list[Open] = []

    def end(node: Open, conv_id: int) -> Iterator[dict[str, Any]]:
        if node.shared:
            node.ids.append(conv_id)
            if len(node.ids) == PART:
                yield ids_of(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv_id).encode())
        else:
            node.ends.update(b",%d" % conv_id)

    def ids_of(node: Open) -> dict[str, Any]:
        node.parts += 1
        ids, node.ids = node.ids, []
        return {"kind": 2, "key": node.key, "cell": cell, "part": node.parts, "ids": ",".join(map(str, ids))}

    def close() -> Iterator[dict[str, Any]]:
        node = path.pop()
        if not node.inner and not node.goes_on:
            node.leaves = 1
        node.saved += node.chars * (node.convs - node.new)
        row = {"depth": node.depth, "conv_id": node.smallest, "n_convs": node.convs, "n_children": node.n_kids, "n_leaves": node.leaves, "saved_tokens": node.saved}
        parent = path[-1] if path else None
        if parent is not None:
            parent.inner = True
            parent.convs += node.convs
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.n_kids += node.new
            parent.smallest = node.smallest if parent.smallest is None else min(parent.smallest, node.smallest)
        for kid in node.kids:
            kid["parent_conv_id"] = node.smallest
            yield kid
        if node.shared:
            if node.ids:
                yield ids_of(node)
            yield row | {"kind": 1, "key": node.key, "parent": parent.key if parent is not None else None}
        else:
            row |= {"kind": 0, "ends_sha256": (node.ends or hashlib.sha256()).hexdigest()}
            if parent is None:
                yield row
            elif parent.shared:
                yield row | {"parent": parent.key}
            else:
                parent.kids.append(row)

    for sequence, conv_id, shared in items:
        while len(path) > shared + 1:
            yield from close()
        before = -1 if last is None else common(sequence, last)
        after = -1 if following is None else common(sequence, following)
        for depth in range(len(path), len(sequence) // UNIT + 1):
            path.append(Open(depth, sequence[: depth * UNIT], before, after))
        node = path[-1]
        node.convs += 1
        node.smallest = conv_id if node.smallest is None else min(node.smallest, conv_id)
        yield from end(node, conv_id)
    while path:
        yield from close()


def units(conversations: DataFrame) -> DataFrame:
    """(conv_id, units in order) of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    unit = F.concat(digest, F.unhex(F.lpad(F.hex(F.char_length(text)), 2 * SIZE, "0")))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), unit.alias("unit")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["unit"]).alias("units"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation c anew: the first h units of conversation c - c % 100, then its own after its first h, with h = crc32(c) % 6."""
    sequences = durable(sequences, "trie-units")
    base = sequences.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("b"), F.slice("units", 1, 5).alias("begin"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    joined = sequences.join(base, F.col("conv_id") - F.col("conv_id") % 100 == F.col("b"), "left")
    begin = F.slice(F.coalesce("begin", F.array().cast("array<binary>")), F.lit(1), h)
    rest = F.slice("units", h + 1, F.greatest(F.size("units"), F.lit(1)))
    return joined.select("conv_id", F.concat(begin, rest).alias("units"))


def sorted_runs(sequences: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(run, no, lcp, conv_id, sequence): the conversations in sorted runs."""
    schema = T.StructType.fromDDL("run long, no long, lcp int, conv_id long, sequence binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, rows = TaskContext.get().partitionId() << 32, 0, []

        def out() -> Iterator[pa.RecordBatch]:
            items = sorted_run(rows)
            for k in range(0, len(items), BATCH):
                some = items[k : k + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run] * len(some), pa.int64()), pa.array(range(k, k + len(some)), pa.int64()), pa.array([x[2] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[0] for x in some], pa.binary())],
                    schema.names,
                )

        for b in batches:
            for conv_id, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append((b"".join(turns), conv_id))
                held += len(rows[-1][0])
                if held > run_bytes:
                    yield from out()
                    run, held, rows = run + 1, 0, []
        if rows:
            yield from out()

    return durable(sequences.mapInArrow(sort, schema), "trie-runs")


def merged_nodes(runs: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Rows of OUT from the runs, cell by cell."""
    spark = runs.sparkSession
    size = runs.agg(F.sum(F.length("sequence") + 16)).first()[0] or 0
    n = max(partitions(spark), -(-size // cell_bytes))
    cells = durable(runs.repartitionByRange(n, "sequence", "conv_id").withColumn("cell", F.spark_partition_id()), "trie-cells")
    ends = cells.groupBy("cell").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last")).withColumn("everything", F.lit(0))
    # a row for each cell: its neighbours' ends come to it as rows 0 and 1 of run -1
    near = ends.select("cell", *(F.expr(f"{f}({c}) OVER (PARTITION BY everything ORDER BY cell)").alias(c) for f, c in (("lag", "last"), ("lead", "first"))))
    seams = near.select("cell", F.lit(-1).cast("long").alias("run"), F.posexplode(F.array("last", "first")).alias("no", "sequence"))
    seams = seams.select("cell", "run", F.col("no").cast("long").alias("no"), F.lit(0).alias("lcp"), F.lit(0).cast("long").alias("conv_id"), "sequence")
    rows = cells.select(*seams.columns).unionAll(seams).repartition(n, "cell").sortWithinPartitions("cell", "run", "no")
    arrow = to_arrow_schema(T.StructType.fromDDL(OUT))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell_rows(cell: int, seam: list[bytes | None], pieces: dict[int, list[Item]]) -> Iterator[dict[str, Any]]:
            yield from finished_nodes(LoserTree(list(pieces.values())), cell, *seam)

        def cells_of() -> Iterator[dict[str, Any]]:
            now, seam, pieces = None, [], {}
            for b in batches:
                for cell, run, _, lcp, conv_id, sequence in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if cell != now:
                        if now is not None:
                            yield from cell_rows(now, seam, pieces)
                        now, seam, pieces = cell, [], {}
                    if run < 0:
                        seam.append(sequence)
                    elif run in pieces:
                        pieces[run].append((sequence, conv_id, lcp))
                    else:
                        pieces[run] = [(sequence, conv_id, 0)]
            if now is not None:
                yield from cell_rows(now, seam, pieces)

        held: list[dict[str, Any]] = []
        for row in cells_of():
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        yield pa.RecordBatch.from_pylist(held, arrow)

    return durable(rows.mapInArrow(merge, OUT), "trie-nodes")


def list_digests(parts: DataFrame) -> DataFrame:
    """(key, ends_sha256) of member lists that come in parts (key, cell, part, ids), each streamed in order."""
    n = max(partitions(parts.sparkSession), 1)
    rows = parts.select("key", "cell", "part", "ids").repartition(n, "key").sortWithinPartitions("key", "cell", "part")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["key", "ends_sha256"])
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key == now:
                    sha.update(b"," + ids.encode())
                else:
                    if now is not None:
                        yield out()
                    now, sha = key, hashlib.sha256(ids.encode())
        if now is not None:
            yield out()

    return rows.mapInArrow(digest, "key binary, ends_sha256 string")


def trie(sequences: DataFrame, run_bytes: int = RUN_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, units): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = merged_nodes(sorted_runs(sequences, run_bytes), cell_bytes)
    whole = lambda c: F.sum(c).cast("long").alias(c)
    seams = rows.where("kind = 1").groupBy("key").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *map(whole, ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    seams = durable(seams, "trie-seams")
    lists = list_digests(rows.where("kind = 2")).withColumnRenamed("key", "k")
    ids = seams.select(F.col("key").alias("p"), F.col("conv_id").alias("of_parent"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = seams.join(lists, F.col("key") == F.col("k"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    shared = shared.join(ids, F.col("parent") == F.col("p"), "left").withColumn("parent_conv_id", F.col("of_parent"))
    inner = rows.where("kind = 0 AND parent IS NULL")
    below = rows.where("kind = 0 AND parent IS NOT NULL").join(ids, F.col("parent") == F.col("p")).withColumn("parent_conv_id", F.col("of_parent"))
    out = inner.select(*columns).unionAll(below.select(*columns)).unionAll(shared.select(*columns))
    return out.withColumn("depth", F.col("depth").cast("long"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they stand."""
    return trie(durable(units(conversations), "trie-units"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(units(load(spark, sf_dir, "conversations"))))
