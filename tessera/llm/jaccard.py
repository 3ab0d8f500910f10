"""N-gram Jaccard join: all documents whose sets of word n-grams are alike, linked through prefix trees.

Two sets link when their Jaccard similarity is at least PERCENT per cent. Equal sets are
found by a 128-bit digest first, so the join below meets distinct sets only.

 1. Sieve. N-grams are hashed to 64 bits, and a set is put in the order of its hashes. Two
    linked sets share at least k(x) = floor(0.8 * SPARE * size) + 1 of the first
    (size - least overlap + SPARE * size) hashes of each. Only these are shuffled; hashes
    that one set alone has there are dropped, then sets with too few left. What stays is
    read from the texts again as whole sets (`candidates`).
 2. Global order. Among those sets n-grams are ordered by the number of sets that hold them,
    rare ones first. Linked sets share one of their first (size - least overlap + 1); sets
    that share none of these are not looked at together. So passages that many documents
    hold stand at the end and join nothing by themselves.
 3. Leaders. Each set is held against the smallest set of the few n-grams that it shares
    first; true links make classes, so a group of thousands of near copies is one class
    before any pair of it is met. N-grams whose sets are all of one class are done.
 4. Blocks. Sets that share one of the n-grams still open, directly or in turn, are a block,
    and are brought together once. A block of more than CELL n-grams is cut into chunks, of
    one class where a class is that large; pairs of chunks are cells, but for two chunks of
    one class. A large block that is no matter of one class is brought together by its
    shared n-grams instead, each cut in the same way. No cell holds more than two chunks.
 5. Prefix tree. A cell's sets are stored in a trie in global order; a set goes down with
    one overlap count for all that share a path, and leaves a subtree when what remains of
    it (or of the set) can't make up the overlap that the subtree's sizes need. Subtrees of
    its own class are passed over. Links found unite classes, so a forest of links is
    reported, never all pairs.

Defined results: null and empty texts, and those without words, have an empty set and link
with nothing, not even each other; fewer words than n are one n-gram of all. A-Z are
lower-cased, nothing else. Repeated rows and texts that differ in repeated n-grams alone
are equal sets. A null doc_id is never a component's smallest unless there is no other.
Long texts are taken whole; one set always fits one task. An empty table gives no rows.
Other columns are not touched, whatever their names. Sets are told apart by 128 bits,
those that link are nodes by 64 of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, load, partitions
from .components import components

WORDS, PERCENT = 5, 80
#: Share of a set that its sieve prefix is longer than it must be.
SPARE = 0.1
#: N-grams that a chunk of a cell holds, about (a single set may be larger).
CELL = 1 << 20
#: Leaders that a set is held against.
LEADERS = 3
#: Up to so many texts that stay, their hashes (8 bytes each) are broadcast.
BROADCAST_TEXTS = 1_000_000
#: Digests that a task remembers, so that it tells a set's prefix once.
SEEN = 1 << 20


def ngrams(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's n-grams, in order."""
    w = (text or b"").lower().split()  # of bytes: ASCII alone
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(b" ".join(w))] if w else [], np.uint64).view(np.int64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((h(line[a:b]) for a, b in spans), np.uint64, len(w) - words + 1).view(np.int64))


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """Elements that a set of this size shares with any set it links to."""
    return -(-percent * size // 100)


def digest(grams: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_digest(grams.astype("<i8").tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sets_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, n, s1, s2, sieve): a row's text hash, set size, set digest, and (once a task, for each set) its sieve prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            sizes, one, two, sieve = [], [], [], []
            for text in b.column(2).cast(pa.binary()):
                g = ngrams(text.as_py(), words)
                n = len(g)
                s1, s2 = digest(g) if n else (0, 0)
                sizes.append(n)
                one.append(s1)
                two.append(s2)
                if n and (s1, s2) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((s1, s2))
                    sieve.append(g[: n - least_overlap(n, percent) + int(SPARE * n) + 1])
                else:
                    sieve.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sieve, pa.list_(pa.int64()))],
                ["doc_id", "th", "n", "s1", "s2", "sieve"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return durable(rows.mapInArrow(run, "doc_id long, th long, n long, s1 long, s2 long, sieve array<long>"), "jaccard-sets")


def in_several(rows: DataFrame, of: str) -> DataFrame:
    """Rows (all columns of which take part) whose gram two different values of `of` have at least: one shuffle, which both sides of the join read."""
    dealt = rows.repartition("gram")
    ends = dealt.groupBy("gram").agg(F.min(of).alias("lo"), F.max(of).alias("hi"), *(F.max(c).alias(f"__{c}") for c in rows.columns if c not in ("gram", of)))
    ends = ends.where("lo != hi").withColumnRenamed("gram", "g")
    met = dealt.join(ends.hint("shuffle_hash"), F.col("gram") == F.col("g"))
    # what the sums are made of is used, so that both sides read the same columns
    return met.where(F.lit(True) if len(rows.columns) == 2 else F.coalesce(*(F.col(f"__{c}") for c in rows.columns if c not in ("gram", of))).isNotNull()).select(*rows.columns)


def survivors(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(s1, n) of sets that share enough of their sieve prefix with others."""
    rows = sets.where("sieve IS NOT NULL").select("s1", F.col("n").cast("int").alias("n"), F.explode("sieve").alias("gram"))
    least = F.floor(percent / 100 * SPARE * F.col("n") * (1 - 1e-9)) + 1
    enough = lambda r: r.groupBy("s1").agg(F.count_distinct("gram").alias("shared"), F.min("n").alias("n")).where(F.col("shared") >= least).select("s1", "n")
    once = durable(in_several(rows, "s1"), "jaccard-sieved")
    first = durable(enough(once), "jaccard-first")
    # those that are left are counted among themselves
    left = once.join(first.select(F.col("s1").alias("x")), F.col("s1") == F.col("x"), "left_semi")
    return durable(enough(in_several(left, "s1")), "jaccard-survivors")


def candidates(docs: DataFrame, sets: DataFrame, alive: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, n, grams) of the sets that are alive, each once."""
    texts = sets.where("n > 0").join(alive.select(F.col("s1").alias("x")), F.col("s1") == F.col("x"), "left_semi")
    texts = durable(texts.groupBy("s1", "s2").agg(F.min("th").alias("k")).select("k").distinct(), "jaccard-texts")
    small = texts.count() <= BROADCAST_TEXTS
    kept = docs.select("text").where("text IS NOT NULL").join(F.broadcast(texts) if small else texts, F.xxhash64("text") == F.col("k"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ids, sizes, grams = [], [], []
            for text in b.column(0).cast(pa.binary()):
                g = ngrams(text.as_py(), words)
                s1 = digest(g)[0] if len(g) else None
                if s1 is not None and s1 not in seen:
                    seen.add(s1)
                    ids.append(s1)
                    sizes.append(len(g))
                    grams.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["id", "n", "grams"])

    found = kept.mapInArrow(run, "id long, n int, grams array<long>")
    return durable(found.groupBy("id").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "jaccard-candidates")


def ordered(found: DataFrame) -> DataFrame:
    """(id, n, grams): the n-grams that two sets or more hold, in global order: by number of sets, then by hash; each as struct<df, gram>."""
    rows = found.select("id", "n", F.explode("grams").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count("*").cast("int").alias("df")).where("df > 1").withColumnRenamed("gram", "g")
    met = rows.join(counts.hint("shuffle_hash"), F.col("gram") == F.col("g"))
    return durable(met.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams")), "jaccard-ordered")


def prefix_rows(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(gram, df, id, n) of the prefixes in global order; n-grams of one set alone come first and are left out."""
    least = F.ceil(F.col("n") * percent / 100)
    most = F.col("n") - least + 1 - (F.col("n") - F.size("grams"))
    prefix = F.slice("grams", F.lit(1), F.greatest(most, F.lit(0)).cast("int"))
    return in_several(sets.select("id", "n", F.explode(prefix).alias("p")).select("p.gram", "p.df", "id", "n"), "id")


def links_to(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) whose sets link."""
    side = lambda x: sets.select(F.col("id").alias(f"{x}i"), F.col("n").alias(f"{x}n"), F.transform("grams", lambda g: g["gram"]).alias(f"{x}g"))
    both = pairs.join(side("a"), F.col("a") == F.col("ai")).join(side("b"), F.col("b") == F.col("bi"))
    shared = F.size(F.array_intersect("ag", "bg"))
    return both.where((100 + percent) * shared >= percent * (F.col("an") + F.col("bn"))).select("a", "b")


def leader_links(rows: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of sets to the leaders (smallest ids) of n-grams in their prefixes, the LEADERS that most of these have."""
    leaders = rows.groupBy("gram").agg(F.min("id").alias("leader")).withColumnRenamed("gram", "g")
    votes = rows.join(leaders, F.col("gram") == F.col("g")).where("id != leader").groupBy("id", "leader").agg(F.count("*").alias("votes"))
    best = votes.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("votes"), F.col("leader").alias("leader")))), 1, LEADERS).alias("best"))
    return links_to(best.select(F.col("id").alias("a"), F.explode("best.leader").alias("b")), sets, percent)


def classed(rows: DataFrame, links: DataFrame, of: str = "id") -> DataFrame:
    """rows with label, the class of their set by links."""
    roots = components(links).select(F.col("node").alias("k"), "root")
    return rows.join(roots, F.col(of) == F.col("k"), "left").withColumn("label", F.coalesce("root", of)).drop("k", "root")


def cells_of(members: DataFrame, cell: int = CELL) -> DataFrame:
    """(unit, i, j, side, id, label): members (unit, id, label, n) in pairs of chunks of their unit; side 0 is chunk i, side 1 chunk j, for i = j there is side 0 alone."""
    per = members.groupBy("unit", "label").agg(F.sum("n").alias("w")).withColumn("large", F.col("w") >= cell)
    rest = per.where("NOT large").groupBy("unit").agg(F.sum("w").alias("rest"))
    per = per.join(rest, "unit", "left").select(F.col("unit").alias("u"), F.col("label").alias("l"), "large", F.ceil(F.when(F.col("large"), F.col("w")).otherwise(F.col("rest")) / cell).alias("parts"))
    placed = members.join(per, (F.col("unit") == F.col("u")) & (F.col("label") == F.col("l")))
    part = F.when(F.col("large"), F.pmod(F.xxhash64("id"), "parts")).otherwise(F.pmod(F.xxhash64("label"), "parts"))
    # a class too large for a chunk has chunks of its own
    pure = F.when(F.col("large"), F.col("label"))
    placed = durable(placed.select("unit", "id", "label", pure.alias("pure"), F.xxhash64(F.col("large"), F.coalesce(pure, F.lit(0)), part).alias("chunk")), "jaccard-chunks")
    chunks = placed.groupBy("unit", "chunk").agg(F.first("pure").alias("pure"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    one = chunks.select(F.col("unit").alias("u"), F.col("chunk").alias("i"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    two = chunks.select(F.col("unit").alias("v"), F.col("chunk").alias("j"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    pairs = one.join(two, (F.col("u") == F.col("v")) & (F.col("i") <= F.col("j")) & ~((F.col("alo") == F.col("ahi")) & (F.col("blo") == F.col("bhi")) & (F.col("alo") == F.col("blo"))))
    sides = pairs.select("u", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("c", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    return placed.join(sides, (F.col("unit") == F.col("u")) & (F.col("chunk") == F.col("c"))).select("unit", "i", "j", "side", "id", "label")


class Tree:
    """A trie of sets (ascending numbers, in global order) with whole stretches as edges, and the sizes and classes below each node."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        #: node: (set whose path it is, begin and end of its edge, its children, sets that end here)
        self.top = [0, 0, 0, [], []]
        path = [self.top]
        before: np.ndarray | None = None
        for k in order:
            s = sets[k]
            shared = 0
            if before is not None:
                m = min(len(s), len(before))
                differ = np.flatnonzero(s[:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            while path[-1] is not self.top and path[-1][1] >= shared:
                path.pop()
            node = path[-1]
            if node[2] > shared:  # its edge splits
                lower = [node[0], shared, node[2], node[3], node[4]]
                node[2], node[3], node[4] = shared, [lower], []
            if len(s) == node[2]:
                node[4].append(k)
            else:
                leaf = [k, node[2], len(s), [], [k]]
                node[3].append(leaf)
                path.append(leaf)
            before = s
        self.bounds(self.top)

    def bounds(self, top: list) -> None:
        """Adds to each node: least and most size below it, longest path below its edge."""
        todo, order = [top], []
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node[3]
        for node in reversed(order):
            sizes = [self.sizes[k] for k in node[4]]
            low = min([*sizes, *(c[5] for c in node[3])], default=0)
            high = max([*sizes, *(c[6] for c in node[3])], default=0)
            rest = max((c[7] + c[2] - c[1] for c in node[3]), default=0)
            node += [low, high, rest]

    def meet(self, s: np.ndarray, size: int, marks: np.ndarray, skip, percent: int, tally: Counter) -> Iterator[int]:
        """Sets whose overlap with s links them to it; marks says of each number whether s holds it, skip of a set whether it needn't be met."""
        todo = [(self.top, 0)]
        while todo:
            node, overlap = todo.pop()
            if 100 * node[6] < percent * size or 100 * size < percent * node[5]:
                tally["pruned by size"] += 1
                continue
            if not node[3] and all(map(skip, node[4])):
                continue
            if node[2] > node[1]:
                edge = self.sets[node[0]][node[1] : node[2]]
                overlap += int(np.count_nonzero(marks[edge]))
                tally["edges"] += 1
                left = len(s) - int(np.searchsorted(s, edge[-1], "right"))
            else:
                left = len(s)
            # the overlap that the smallest set below needs is out of reach
            if (100 + percent) * (overlap + min(left, node[7])) < percent * (size + max(node[5], -(-percent * size // 100))):
                tally["pruned by rest"] += 1
                continue
            for k in node[4]:
                if (100 + percent) * overlap >= percent * (size + self.sizes[k]) and not skip(k):
                    yield k
            todo += [(c, overlap) for c in node[3]]


def cell_links(sets: list[np.ndarray], sizes: list[int], labels: list[int], sides: list[int], percent: int = PERCENT, tally: Counter | None = None) -> list[tuple[int, int]]:
    """Links (places in the lists) between sets of the two sides (of the one side, if there is one) that unite their classes; sets are arrays of numbers in global order."""
    tally = Counter() if tally is None else tally
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = above[x]
        return x

    stored = [k for k, s in enumerate(sides) if not s]
    asking = [k for k, s in enumerate(sides) if s] or stored
    out: list[tuple[int, int]] = []
    if not stored:
        return out
    # the class with most members needn't ask if it is stored as well: the others meet it
    if asking is stored:
        most = Counter(labels[k] for k in stored).most_common(1)[0][0]
        asking = [k for k in stored if labels[k] != most]
    elif len(asking) > len(stored):
        stored, asking = asking, stored
    tree = Tree([sets[k] for k in stored], [sizes[k] for k in stored])
    marks = np.zeros(max((int(s[-1]) for s in sets if len(s)), default=0) + 1, bool)
    for a in asking:
        marks[sets[a]] = True
        for k in tree.meet(sets[a], sizes[a], marks, lambda k, a=a: find(labels[stored[k]]) == find(labels[a]), percent, tally):
            b = stored[k]
            x, y = find(labels[a]), find(labels[b])
            if x != y:
                above[max(x, y)] = min(x, y)
                out.append((a, b))
        marks[sets[a]] = False
    return out


def joined(cells: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) found in the cells' prefix trees."""
    rows = cells.join(sets.select(F.col("id").alias("k"), "n", F.col("grams.df").alias("df"), F.col("grams.gram").alias("gram")), F.col("id") == F.col("k"))
    key = ["unit", "i", "j"]
    rows = rows.select(*key, "side", "id", "label", "n", "df", "gram").repartition(max(partitions(sets.sparkSession), 1), *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(held: list[tuple]) -> pa.RecordBatch:
            lengths = [len(r[5]) for r in held]
            df, gram = np.concatenate([r[4] for r in held]), np.concatenate([r[5] for r in held])
            order = np.lexsort((gram, df))
            new = np.concatenate([[0], np.cumsum((gram[order][1:] != gram[order][:-1]))])
            number = np.empty(len(gram), np.int64)
            number[order] = new
            sets = np.split(number, np.cumsum(lengths)[:-1])
            got = cell_links(sets, [r[3] for r in held], [r[2] for r in held], [r[0] for r in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([held[a][1] for a, _ in got], pa.int64()), pa.array([held[b][1] for _, b in got], pa.int64())], ["a", "b"])

        now, held = None, []
        for b in batches:
            keys = list(zip(*(c.to_pylist() for c in b.columns[:7]), strict=True))
            for k, row in enumerate(keys):
                if row[:3] != now:
                    if held:
                        yield search(held)
                    now, held = row[:3], []
                held.append((*row[3:], b.column(7)[k].values.to_numpy(), b.column(8)[k].values.to_numpy()))
        if held:
            yield search(held)

    return rows.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, words: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """Links (a, b) between the s1 of different sets that connect what all links connect; durable."""
    found = candidates(docs, sets, survivors(sets, percent), words)
    order = ordered(found)
    rows = durable(prefix_rows(order, percent), "jaccard-prefixes")
    led = durable(leader_links(rows, order, percent), "jaccard-leaders")
    labelled = classed(rows.select("gram", "id", "n"), led)
    ends = labelled.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("least")).where("lo != hi").select(F.col("gram").alias("g"), "least")
    open_ = durable(labelled.join(ends, F.col("gram") == F.col("g")).drop("g"), "jaccard-open")
    block = components(durable(open_.select(F.col("id").alias("a"), F.col("least").alias("b")).where("a != b").distinct(), "jaccard-stars"))
    sets_in = open_.select("id", "label", "n").distinct().join(block.select(F.col("node").alias("k"), F.col("root").alias("unit")), F.col("id") == F.col("k")).drop("k")
    sets_in = durable(sets_in, "jaccard-blocks")
    # a block that neither fits a chunk nor is one class but for a chunk's worth is cut by its n-grams
    sizes = sets_in.groupBy("unit", "label").agg(F.sum("n").alias("w")).groupBy("unit").agg(F.sum("w").alias("all"), F.max("w").alias("most"))
    large = sizes.where(F.col("all") - F.col("most") > cell).select(F.col("unit").alias("u"))
    by_block = sets_in.join(large, F.col("unit") == F.col("u"), "left_anti").select("unit", "id", "label", "n")
    in_large = sets_in.join(large, F.col("unit") == F.col("u"), "left_semi").select(F.col("id").alias("k"))
    by_gram = open_.join(in_large, F.col("id") == F.col("k"), "left_semi").select(F.col("gram").alias("unit"), "id", "label", "n")
    cells = durable(cells_of(by_block, cell).unionAll(cells_of(by_gram, cell)), "jaccard-cells")
    return durable(led.unionAll(joined(cells, order, percent)), "jaccard-links")


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sets = sets_of(docs, words, percent)
    roots = components(links(docs, sets, words, percent, cell)).select(F.col("node").alias("k"), "root")
    distinct = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    rooted = durable(distinct.join(roots, F.col("s1") == F.col("k"), "left").drop("k"), "jaccard-rooted")
    least = rooted.where("root IS NOT NULL").groupBy(F.col("root").alias("r")).agg(F.min("id").alias("least"))
    ids = rooted.join(least, F.col("root") == F.col("r"), "left").select(F.col("s1").alias("x1"), F.col("s2").alias("x2"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    full = sets.where("n > 0").join(ids, (F.col("s1") == F.col("x1")) & (F.col("s2") == F.col("x2"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionAll(sets.where("n = 0").select("doc_id", "n", "doc_id"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(load(spark, sf_dir, "documents"))
