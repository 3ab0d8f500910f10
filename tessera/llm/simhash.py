"""SimHash near-duplicates, linked by vantage-point trees over Hamming distance.

A document's fingerprint takes the majority of each bit over the hashes of its
4-word shingles. Fingerprints that differ in at most RADIUS bits are linked, and
documents belong to the components of these links.

Search: only distinct fingerprints are searched, in overlapping shards.

 1. Views. The 64 bits are cut into RADIUS + 1 blocks; a linked pair agrees in one of
    them at least (RADIUS differing bits leave one untouched). In a view, fingerprints
    that agree in its block's lowest bits stand together: as many bits as leave about
    SHARD fingerprints, so shards keep their size as the corpus grows. One tree over all
    64 bits would prune little: unlike fingerprints crowd at distance 32.
 2. Vantage points. Each view has one, and its median distance m cuts every shard in
    two: members within m, and those beyond. A pair that the boundary parts has its
    inner half at a distance above m - RADIUS, so exactly these visit the outer shard
    too (the triangle bound); visitors ask there, and are not asked.
 3. Trees. In a shard a vantage-point tree splits the members at the median distance to
    a vantage point, down to leaves of LEAF; members and visitors enter a branch only
    where the bound leaves room (d <= median + RADIUS inside, d > median - RADIUS
    outside), both where they overlap the boundary.

A shard of more than SHARD_MOST members is dealt anew, both halves together, by blocks
of the bits that it doesn't agree in yet, until no shard is too large or no bits are left.

A shard reports a spanning forest of its links, never all pairs, so thousands of
near copies yield as many edges. Components come from star steps over the edges.

Defined results: null and empty texts have fingerprint zero, linked like any other.
Fewer than 4 words: one shingle of all of them; a bit set in just half of the hashes
is 0. Repeated rows are copies. A null doc_id is never a component's smallest unless
there is no other. An empty table gives no rows. Other columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, load, masked, partitions, unmasked
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: About how many fingerprints agree in a view's bits; above SHARD_MOST members a shard is dealt anew by its other bits.
SHARD, SHARD_MOST = 1000, 12_000
#: Fingerprints that a tree's leaf holds at most.
LEAF = 32
CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII alone
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((h(line[a:b], SEED) for a, b in spans), np.uint64, n)
    for k in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, keep: list[str], name: str = "fp") -> DataFrame:
    """The columns of `keep` and each row's fingerprint as a (signed) long."""
    source = docs.select(F.col("text").alias("__text"), *keep)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py()) for t in b.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(f)], [*keep, name])

    return source.mapInArrow(run, schema)


def cut_bits(mask: int, parts: int = RADIUS + 1, most: int = 64) -> list[int]:
    """The bits outside mask, cut into `parts` blocks of nearly equal size; of each its `most` lowest bits, with mask's own."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[len(free) * k // parts : len(free) * (k + 1) // parts][:most]) for k in range(parts)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of each pair (i, j); root[x] leads to its set's least member, and is flat afterwards."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :])


def link(fps: np.ndarray, members: int | None = None, radius: int = RADIUS, tally: Counter | None = None) -> np.ndarray:
    """Per fingerprint, the least index that links lead to: a vantage-point tree of the first `members`, queried by all.

    tally counts vantage points, visits that the triangle bound spared, and comparisons.
    """
    tally = Counter() if tally is None else tally
    root = np.arange(len(fps))
    todo = [(np.arange(len(fps) if members is None else members), np.arange(len(fps)))]  # a branch's members, and the queries that may meet them
    while todo:
        inside, queries = todo.pop()
        if not len(inside) or not len(queries):
            continue
        if len(inside) <= LEAF:
            tally["compared"] += len(inside) * len(queries)
            for k in range(0, len(queries), CHUNK // LEAF):
                q = queries[k : k + CHUNK // LEAF]
                x, y = np.nonzero(distances(fps[q], fps[inside]) <= radius)
                unite(root, q[x], inside[y])
            continue
        vantage = inside[len(inside) // 2]
        tally["vantage points"] += 1
        d = np.bitwise_count(fps[inside] ^ fps[vantage])
        dq = np.bitwise_count(fps[queries] ^ fps[vantage])
        median = int(np.median(d))
        near = d <= median
        if near.all():  # the median is the largest distance: split off what lies nearer
            median -= 1
            near = d <= median
            if not near.any():
                median, near = 0, d == 0
        met = queries[dq <= radius]
        unite(root, met, np.full(len(met), vantage))
        dq16 = dq.astype(np.int16)
        for branch, asks in ((inside[near], dq16 <= median + radius), (inside[~near], dq16 > median - radius)):
            tally["spared"] += int((~asks).sum())
            todo.append((branch, queries[asks]))
    return root


def halves(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, outer, own, fp): each fingerprint of nodes (mask, fp) in its half of a shard (own), and as a visitor in the outer one.

    nodes come with the masks that they are dealt by; a mask's vantage point is one of them, and its median distance cuts its shards.
    """
    by = F.xxhash64("mask", "fp")
    points = {r["mask"]: r["v"] for r in nodes.groupBy("mask").agg(F.min_by("fp", by).alias("v")).collect()}  # one for each mask
    found = F.create_map(*(c for m in masks for c in (F.lit(signed(m)).cast("long"), F.lit(points.get(signed(m), 0)).cast("long"))))
    placed = nodes.withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(found[F.col("mask")])).cast("int"))
    medians = {r["mask"]: int(r["m"]) for r in placed.groupBy("mask").agg(F.percentile_approx("d", 0.5, 100).alias("m")).collect()}
    median = F.create_map(*(c for m in masks for c in (F.lit(signed(m)).cast("long"), F.lit(medians.get(signed(m), 0)))))
    placed = placed.withColumn("m", median[F.col("mask")])
    outer = F.col("d") > F.col("m")
    visits = ~outer & (F.col("d") > F.col("m") - RADIUS)
    half = lambda side, own: F.struct(side.alias("outer"), F.lit(own).alias("own"))
    each = F.when(visits, F.array(half(F.lit(False), True), half(F.lit(True), False))).otherwise(F.array(half(outer, True)))
    return placed.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp", F.explode(each).alias("e")).select("mask", "key", "e.outer", "e.own", "fp")


def views(rows: DataFrame, parts: dict[int, list[int]]) -> DataFrame:
    """rows (mask, fp) dealt by each of the masks that `parts` gives for theirs."""
    table = rows.sparkSession.createDataFrame([(signed(m), [signed(x) for x in p]) for m, p in parts.items()], "m long, __parts array<long>")
    return rows.join(F.broadcast(table), F.col("mask") == F.col("m")).select(F.explode("__parts").alias("mask"), "fp")


def shards(nodes: DataFrame, size: int = SHARD, most: int = SHARD_MOST) -> DataFrame:
    """(mask, key, outer, own, fp): every fingerprint in its shards, as a member (own) or a visitor; large shards dealt anew."""
    n = nodes.count()
    bits = max(0, (max(n, 1) - 1) // size).bit_length()
    masks = sorted(set(cut_bits(0, most=bits)))  # without bits all views are one
    rows = nodes.select(F.explode(F.array(*(F.lit(signed(m)).cast("long") for m in masks))).alias("mask"), "fp")
    done = None
    while True:
        rows = durable(rows, "simhash-dealt")
        dealt = halves(rows, masks)
        # a shard is dealt anew as long as bits are left that can part it
        open_ = [signed(m) for m in masks if m.bit_count() < 64 - RADIUS]
        sizes = dealt.where("own").groupBy("mask", "key", "outer").agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = durable(sizes.where(F.col("mask").isin(open_)).select(F.col("mask").alias("m"), F.col("key").alias("k")).distinct(), "simhash-large")
        again = [r["m"] % (1 << 64) for r in large.select("m").distinct().collect()]  # masks, not fingerprints: a few, whatever the corpus
        cond = (F.col("mask") == F.col("m")) & (F.col("key") == F.col("k"))
        part = dealt.join(large, cond, "left_anti") if again else dealt
        done = part if done is None else done.unionAll(part)
        if not again:
            return done
        deeper = {m: cut_bits(m) for m in again}
        kept = rows.withColumn("key", F.col("mask").bitwiseAND(F.col("fp"))).join(large, cond, "left_semi")
        rows, masks = views(kept.select("mask", "fp"), deeper).distinct(), sorted({x for p in deeper.values() for x in p})


def edges(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect what links connect."""
    spread = shards(nodes)
    n = max(partitions(nodes.sparkSession), 1)
    grouped = spread.select("mask", "key", F.col("outer").cast("long").alias("outer"), (~F.col("own")).cast("long").alias("visits"), "fp").repartition(n, "mask", "key", "outer").sortWithinPartitions("mask", "key", "outer", "visits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def search(rows: np.ndarray) -> pa.RecordBatch:
            """rows: (mask, key, outer, visits, fp), whole shards in order."""
            new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            a, b = [], []
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(rows)], strict=True):
                members = int((rows[lo:hi, 3] == 0).sum())
                if hi - lo > 1 and members:
                    fps = np.ascontiguousarray(rows[lo:hi, 4])
                    root = link(fps.view(np.uint64), members)
                    k = np.flatnonzero(root != np.arange(hi - lo))
                    a.append(fps[k])
                    b.append(fps[root[k]])
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
                rows = held[-1]
                if (rows[0, :3] != rows[-1, :3]).any():  # the last shard may go on in the next batch
                    begin = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))[-1]) + 1
                    yield search(np.concatenate([*held[:-1], rows[:begin]]))
                    held = [rows[begin:]]
        if held:
            yield search(np.concatenate(held))

    return grouped.mapInArrow(run, "a long, b long")


def groups(fps: DataFrame) -> DataFrame:
    """(fp, component_id, representative fp) for each distinct fingerprint of fps (doc_id, fp), which should be durable."""
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    roots = components(durable(edges(nodes).distinct(), "simhash-edges"))
    rooted = durable(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    ids = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id", "id", "root")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = durable(with_fingerprints(load(spark, sf_dir, "documents"), ["doc_id"]), "simhash-fps")
    found = groups(fps).select(F.col("fp").alias("__fp"), "component_id")
    out = fps.join(found, F.col("fp") == F.col("__fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs: that of the smallest doc_id."""
    docs, names = masked(docs, ("doc_id", "text"))
    fps = durable(with_fingerprints(docs, ["doc_id"]), "simhash-fps")
    found = groups(fps)
    # one fingerprint of each group stands for it: the least of those whose smallest doc_id is the group's
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("__kept"), F.first("component_id").alias("__id"))
    kept = durable(kept.select("__kept", "__id"), "simhash-kept")
    marked = with_fingerprints(docs, docs.columns, "__fp")
    stays = marked.join(kept, (F.col("__fp") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__kept", "__id")
    return unmasked(stays.dropDuplicates(["__fp", "doc_id"]), names)
