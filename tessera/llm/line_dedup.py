"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

A line goes if an equal line stands earlier in the corpus (by doc_id, then by place),
or if a line that is linked to it first stands earlier. Lines of white space alone take
no part and stay.

Links: two different lines are linked if they are within EDITS edits and at most DIFFER
per cent of the longer one's characters: one edit from 5 characters on, two from 10 on.
So pairs fall into bands by the length of the longer line, each with its own number of
edits, and each band is joined on its own (`bands`).

Exact copies: lines are hashed to 128 bits where they are read; the first place and
the number of places of each hash come from sums that are made before the shuffle.

Near copies: each distinct line is cut into edits + 1 segments by its length; two
lines within so many edits share one of them, at places that differ by no more than
the edits on either side allow. So a line enters the index with its own segments and
probes those of lines up to that much shorter at the few places that can match
(length-aware). Only hashes, of (length, segment number, segment) and of the line, are
shuffled, straight from the documents; rows that meet no other line's are dropped, and
texts are fetched for the rest.

Filter: an edit turns at most two of the parities of how often each letter stands in a
line, so the lines of a key are paired only if their parities differ in no more than
twice the edits. Copies of one text, each with a word or two of its own, have nearly the
same letters; so lines of crowded keys (over CROWD rows) also hold the parities of their
pairs of neighbouring characters, in CLASSES classes by hash, of which an edit turns at most
four: a character that is replaced takes two pairs along and brings two. What a key can cost is bounded by HOT.

Hot segments: where more than HOT lines share a key, no pairs are made. The shared
segment is cut out and the rest of the lines is joined in the same way within the
key, as often as needed: what is left shrinks each time, until an index row has as many
characters as there are edits, or fewer. It then meets all rests of its key, which are
up to so much longer: lines that agree in all but so little are few, and nearly all
linked. So no group is paired off at large, and no link is lost. Links themselves are
written pair by pair, for they are counted: lines that differ in two characters at
most, each from each, have as many as they are by twos.

Check: banded bit-parallel edit distance. One register of 2 * edits + 1 bits for each
number of edits holds the reachable cells of a band around the diagonal; a character
moves all of them on with a few bit operations, and none once all are empty. Equal
beginnings are cut off first, in steps of STEPS characters, then HEAD characters are
worked through, which settle most pairs; of the rest, equal ends are cut off too.

Defined results: null and empty texts have one empty line, which stays. A null doc_id
comes last in order. Rows of one doc_id don't remove each other's lines at the same
place, so repeated rows fare alike. Lines that tie in their first place are one line.
Lines are cut at \\n alone; other columns, but n_chars where it is asked for, are not
touched, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, load, masked, unmasked
from .components import components

#: Most edits between linked lines, and most per cent of the longer one's characters.
EDITS, DIFFER = 2, 20
HOT, STEPS, HEAD = 512, (32, 4), 24
#: Lines that share a key with more rows than CROWD hold the parities of their pairs of characters, too: two words of bits.
CROWD, CLASSES = 16, 128
#: The characters whose parities are held.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 .,-"
#: Up to so many lines that may have links, their hashes are broadcast (16 bytes each) to fetch their texts.
BROADCAST_IDS = 1_000_000
#: Places within a document; doc_id * PLACES + place orders lines.
PLACES = 10**10
LAST = (1 << 63) - 1
#: Rows without a doc_id are nodes of their own above this, told apart by their text.
NO_ID = LAST - (1 << 40)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def bands(edits: int = EDITS, differ: int = DIFFER) -> list[tuple[int, int, int | None]]:
    """(edits, least, most length of the longer line) of each band of pairs."""
    starts = [-(-100 * e // differ) for e in range(1, edits + 1)]
    return [(e, lo, hi - 1 if hi else None) for e, lo, hi in zip(range(1, edits + 1), starts, [*starts[1:], None], strict=True)]


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift) of each segment that a line looks up; (0, i, 0) are its own, which index it."""
    return [
        (short, i, shift)
        for short in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, short - (edits - i)), min(i, short + edits - i) + 1)
    ]


def is_index(probe: tuple[int, int, int]) -> bool:
    return probe[0] == 0 and probe[2] == 0


def parameters(edits: int, first: bool) -> list[dict[str, int]]:
    """Each segment that lines index or look up, for each number of edits. first: for whole lines, with the lengths of their band."""
    out = []
    for e, least, most in bands(edits):
        for short, i, shift in probes(e):
            own = is_index((short, i, shift))
            lo, hi = (least - e if own else least, (1 << 30) if most is None else most) if first else (e + 1, 1 << 30)
            out.append({"e": e, "short": short, "i": i, "shift": shift, "own": int(own), "lo": lo, "hi": hi})
    return out


def cut(n: Column, p: dict[str, Column] | Column) -> tuple[Column, Column]:
    """Begin (from 0) and size of a probe's segment in a line of n characters."""
    of, parts = n - p["short"], p["e"] + 1
    begin, end = F.floor(of * p["i"] / parts), F.floor(of * (p["i"] + 1) / parts)
    return (begin + p["shift"]).cast("int"), (end - begin).cast("int")


def segment_rows(rows: DataFrame, keep: list[str], text: str, edits: int, within: str | None = None, only_own: bool = False) -> DataFrame:
    """rows' `keep` with key and p, the parameters of its segment; `own` of rows, where they have it, says whether they may index."""
    use = [p for p in parameters(edits, within is None) if p["own"] or not only_own]
    each = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in p.items())) for p in use))
    wide = rows.withColumn("__n", F.char_length(text)).select(*keep, *({text, "__n"} - set(keep)), *([within] if within and within not in keep else []), *(["own"] if "own" in rows.columns and "own" not in keep else []), F.explode(each).alias("p"))
    n, p = F.col("__n"), F.col("p")
    begin, size = cut(n, p)
    fits = (n >= p["lo"]) & (n <= p["hi"]) & (begin >= 0) & (begin + size <= n) & (n >= p["short"])
    if "e" in rows.columns:  # what is left of lines stays with their number of edits
        fits &= p["e"] == F.col("e")
    key = F.xxhash64(*([within] if within else []), p["e"], n - p["short"], p["i"], F.substring(F.col(text), begin + 1, size))
    own = (p["own"] == 1) & F.col("own") if "own" in rows.columns else p["own"] == 1
    return wide.where(fits).select(*keep, key.alias("key"), own.alias("own"), p["e"].cast("byte").alias("e"), p["short"].cast("byte").alias("short"), p["i"].cast("byte").alias("i"), p["shift"].cast("byte").alias("shift"))


ROW = ["id", "key", "own", "e", "short", "i", "shift"]


def shared(own: DataFrame, rows: DataFrame, more: list[str]) -> DataFrame:
    """Rows (ROW and `more`) of keys that an index row and another line's row have, with n: how many. own: the index rows among them."""
    counts = own.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).withColumnRenamed("key", "k")
    several, asks = F.col("lo") != F.col("hi"), ~F.col("own") & (F.col("id") != F.col("lo"))
    met = rows.join(counts.hint("shuffle_hash"), F.col("key") == F.col("k")).where(several | asks)
    # a key that one line alone indexes: asking rows bring it with them
    return durable(met.select(*ROW, *more, F.when(~several, F.col("lo")).alias("only")).distinct(), "line-met")


def counted(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).withColumnRenamed("key", "k")
    return durable(rows.join(sizes, F.col("key") == F.col("k")).drop("k"), "line-level")


def parities(line: Column) -> Column:
    """Whether each of LETTERS stands an odd number of times in a line, as bits."""
    return F.aggregate(F.array(*map(F.lit, LETTERS)), F.lit(0).cast("long"), lambda a, c: a * 2 + (F.char_length(line) - F.char_length(F.replace(line, c, F.lit("")))) % 2)


def pair_parities(line: Column) -> Column:
    """Whether each of CLASSES classes of pairs of neighbouring characters (the last one's neighbour is the end) stands an odd number of times in a line, as bits of two words."""
    half = CLASSES // 2
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(half - 1)).cast("int"))
    word = lambda hashes, k: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: F.when(h.bitwiseAND(F.lit(half)) == k * half, a.bitwiseXOR(bit(h))).otherwise(a))
    hashes = let(F.split(line, ""), lambda c: F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + 1))))
    return let(hashes, lambda h: F.struct(word(h, 0).alias("low"), word(h, 1).alias("high")))


def signature(line: Column, crowded: Column) -> Column:
    """struct<letters, pairs>: a line's parities; pairs is null where the line is in no crowded key."""
    return F.struct(parities(line).alias("letters"), F.when(crowded, pair_parities(line)).alias("pairs"))


def may_link(a: Column, b: Column, edits: Column) -> Column:
    """Whether the signatures of two lines allow so many edits."""
    turned = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    by_pairs = turned(a["pairs"]["low"], b["pairs"]["low"]) + turned(a["pairs"]["high"], b["pairs"]["high"]) <= 4 * edits
    return (turned(a["letters"], b["letters"]) <= 2 * edits) & F.coalesce(by_pairs, F.lit(True))


def paired(rows: DataFrame, which: Column | None = None) -> DataFrame:
    """Pairs (a, b) of an index row (of those for which `which` holds) and another one of the same key, which few rows have, whose signatures (`parity`) allow a link."""
    left = rows.where(F.col("own") if which is None else F.col("own") & which).select("key", "e", F.col("id").alias("a"), F.col("parity").alias("pa"))
    right = rows.select(F.col("key").alias("k"), F.col("id").alias("b"), F.col("parity").alias("pb"))
    near = may_link(F.col("pa"), F.col("pb"), F.col("e").cast("int"))
    return left.join(right, (F.col("key") == F.col("k")) & (F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def within_edits(x: Column, y: Column, edits: int, allowed: Column | None = None) -> Column:
    """Whether two texts are within so many edits, or within `allowed` (at most edits) of them: banded, bit-parallel."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    at = lambda word, shift: F.shiftrightunsigned(word, shift) if shift >= 0 else F.shiftleft(word, -shift)
    register = lambda s, d: at(s, width * d).bitwiseAND(F.lit(full))

    def strip(a: Column, b: Column, step: int, most: int) -> Column:
        """struct<a, b> without equal beginnings, in up to `most` steps and one."""
        steps = F.sequence(F.lit(0), F.least(F.lit(most), F.floor(F.least(F.length(a), F.length(b)) / step)).cast("int"))
        differs = F.transform(steps, lambda k: F.substring(a, k * step + 1, F.lit(step)) != F.substring(b, k * step + 1, F.lit(step)))
        rest = lambda x, k: F.substring(x, (k * step + 1).cast("int"), F.lit(1 << 30))
        after = lambda p: F.when(p == 0, F.size(steps)).otherwise(p - 1)
        return let(let(F.array_position(differs, True), after), lambda k: F.struct(rest(a, k).alias("a"), rest(b, k).alias("b")))

    def stripped(a: Column, b: Column) -> Column:
        return let(strip(a, b, STEPS[0], 1 << 30), lambda s: strip(s["a"], s["b"], STEPS[1], STEPS[0] // STEPS[1]))

    first = sum(sum(1 << (k + width * d) for k in range(edits, edits + d + 1)) for d in range(edits + 1))

    start = F.lit(first).cast("long")

    def walk(p: Column, t: Column) -> Column:
        """The registers after all characters of t."""

        def move(state: Column, j: Column) -> Column:
            here = F.get(t, j - 1)
            equal = F.lit(0).cast("long")
            for k in range(width):
                equal = equal.bitwiseOR(F.when((j + k - edits >= 1) & F.get(p, j + k - edits - 1).eqNullSafe(here), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
            new, out = None, F.lit(0).cast("long")
            for d in range(edits + 1):
                now = register(state, d).bitwiseAND(equal)
                if d:
                    less = register(state, d - 1)
                    now = now.bitwiseOR(less).bitwiseOR(at(less, 1)).bitwiseOR(at(new, -1)).bitwiseAND(F.lit(full))
                new = now
                out = out.bitwiseOR(at(now, -width * d))
            return F.when(state == 0, state).otherwise(out)

        return F.when(F.size(t) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), start, move))

    chars = lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))

    def lives(s: Column) -> Column:
        """Whether the beginnings leave any cell."""
        both = F.struct(chars(F.substring(s["a"], 1, HEAD + edits)).alias("p"), chars(F.substring(s["b"], 1, HEAD)).alias("t"))
        return let(both, lambda v: walk(v["p"], v["t"]) != 0)

    def whole(v: Column) -> Column:
        p, t = v["p"], v["t"]
        # the bit of the last cell, in the register of the edits that are allowed
        place = (F.size(p) - F.size(t) + edits + width * (F.lit(edits) if allowed is None else v["d"])).cast("int")
        return let(walk(p, t), lambda end: F.get(F.array(*(at(end, k).bitwiseAND(F.lit(1)) == 1 for k in range(width * (edits + 1)))), place))

    ends = lambda s: stripped(F.reverse(s["a"]), F.reverse(s["b"]))
    rest = lambda s: let(ends(s), lambda s: let(F.struct(chars(s["a"]).alias("p"), chars(s["b"]).alias("t"), *([] if allowed is None else [allowed.alias("d")])), whole))
    return (F.abs(F.length(x) - F.length(y)) <= edits) & let(stripped(x, y), lambda s: lives(s) & rest(s))


def order_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def node_of(d: Column, th: Column) -> Column:
    """The node of a row in the graph of classes: its doc_id, or a number beyond NO_ID."""
    return F.when(d == LAST, LAST - th.bitwiseAND(F.lit((1 << 40) - 1))).otherwise(d)


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines that take part: d, th (row), pos, h1, h2 (128-bit hash), line."""
    rows = docs.select(order_id(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("line"), "line")})


def near_links(docs: DataFrame, edits: int) -> DataFrame:
    """Links (a1, a2, b1, b2) between hashes of different lines that are within the edits that their lengths allow."""
    lines = lines_of(docs).select(F.col("h1").alias("id"), "line")
    found = shared(segment_rows(lines, ["id"], "line", edits, only_own=True), segment_rows(lines, ["id"], "line", edits), [])
    # the one line that indexes a key, as a row of its own
    owner = found.where("only IS NOT NULL").select(F.col("only").alias("id"), "key", F.lit(True).alias("own"), "e", F.lit(0).cast("byte").alias("short"), "i", F.lit(0).cast("byte").alias("shift"))
    level = counted(found.select(*ROW).unionByName(owner).distinct())
    ids = durable(level.groupBy(F.col("id").alias("k")).agg((F.max("n") > CROWD).alias("crowded")), "line-ids")
    small = ids.count() <= BROADCAST_IDS
    texts = lines_of(docs).select("h1", "h2", "line").join(F.broadcast(ids) if small else ids, F.col("h1") == F.col("k")).drop("k")
    texts = durable(texts.dropDuplicates(["h1", "h2"]).withColumn("parity", signature(F.col("line"), F.col("crowded"))).drop("crowded"), "line-texts")
    pairs = paired(level.where(F.col("n") <= HOT).join(texts.select(F.col("h1").alias("id"), "parity"), "id"))
    hot = level.where(F.col("n") > HOT).drop("n").join(texts.select(F.col("h1").alias("id"), F.col("line").alias("rest"), "parity"), "id")
    while True:
        hot = durable(hot, "line-hot")
        if hot.isEmpty():
            break
        begin, length = cut(F.char_length("rest"), {k: F.col(k).cast("int") for k in ("e", "short", "i", "shift")})
        cutout = hot.withColumns({"__b": begin, "__s": length})
        cutout = cutout.select("id", "own", "e", "parity", F.col("key").alias("parent"), F.concat(F.substring("rest", F.lit(1), F.col("__b")), F.substring(F.col("rest"), F.col("__b") + F.col("__s") + 1, F.lit(1 << 30))).alias("rest"))
        cutout = durable(cutout.distinct(), "line-rest")
        # index rests of a parent are equally long; those too short to be cut meet the rests that are up to so many edits longer
        size = F.char_length("rest")
        pairs = pairs.unionAll(paired(cutout.where(size <= 2 * F.col("e")).withColumn("key", F.col("parent")), size <= F.col("e")))
        again = segment_rows(cutout.where(size > F.col("e")), ["id", "rest", "parity"], "rest", edits, "parent")
        found = shared(again.where("own"), again, ["rest", "parity"])
        alone = found.where("only IS NOT NULL").select("key", F.col("only").alias("id"), "e", "i").distinct()
        owner = alone.join(again.where("own"), ["key", "id", "e", "i"]).select(*ROW, "rest", "parity")
        level = counted(found.select(*ROW, "rest", "parity").unionByName(owner).distinct())
        pairs = pairs.unionAll(paired(level.where(F.col("n") <= HOT)))
        hot = level.where(F.col("n") > HOT).drop("n")
    pairs = durable(pairs.distinct(), "line-pairs")
    text = lambda x: texts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"{x}t"))
    both = pairs.join(text("a"), F.col("a") == F.col("a1")).join(text("b"), F.col("b") == F.col("b1"))
    longer = F.greatest(F.char_length("at"), F.char_length("bt"))
    allowed = F.lit(0)
    for e, least, _ in bands(edits):
        allowed = F.when(longer >= least, e).otherwise(allowed)
    both = both.withColumn("__d", allowed).where("__d > 0")
    return durable(both.where(within_edits(F.col("at"), F.col("bt"), edits, F.col("__d"))).select("a1", "a2", "b1", "b2"), "line-links")


def marked_lines(docs: DataFrame, edits: int = EDITS, classes: bool = True) -> DataFrame:
    """Rows of documents with lines that are repeated or linked: d, th, gone (their places), near (those gone for a link alone), linked; with classes also class.

    A class is a connected component: rows belong together if they have an equal line,
    or two lines that are linked, or are so joined by others. class: its least doc_id.
    """
    order = F.col("d").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(12,0)") + F.col("pos")
    order = order.cast("decimal(38,0)")
    places = durable(lines_of(docs).drop("line"), "line-places")
    distinct = durable(places.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.min(node_of(F.col("d"), F.col("th"))).alias("home"), F.count("*").alias("n")), "line-distinct")
    links = near_links(docs, edits)
    ends = links.unionAll(links.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    firsts = distinct.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("other"))
    linked = ends.join(firsts, ["b1", "b2"]).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.count("*").alias("links"), F.min("other").alias("other"))
    notable = distinct.join(linked, ["h1", "h2"], "left").where("n > 1 OR links IS NOT NULL").select("h1", "h2", "first", "home", "links", "other")
    met = places.join(durable(notable, "line-notable"), ["h1", "h2"])
    repeat, near = F.col("first") < order, F.coalesce(F.col("other") < F.col("first"), F.lit(False))
    gone = met.withColumns({"repeat": repeat, "near": near})
    out = gone.groupBy("d", "th").agg(
        F.collect_set(F.when(F.col("repeat") | F.col("near"), F.col("pos"))).alias("gone"),
        F.collect_set(F.when(~F.col("repeat") & F.col("near"), F.col("pos"))).alias("near"),
        F.collect_set(F.when(F.col("links") > 0, F.struct("pos", "links"))).alias("linked"),
        *([F.collect_set("home").alias("homes")] if classes else []),
    )
    if not classes:
        return out
    # each row is joined to the homes of its lines, and the homes of linked lines to each other
    out = durable(out.withColumn("node", node_of(F.col("d"), F.col("th"))), "line-marks")
    home = lambda x: distinct.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("home").alias(x))
    across = links.join(home("a"), ["a1", "a2"]).join(home("b"), ["b1", "b2"]).select("a", "b")
    edges = out.select(F.col("node").alias("a"), F.explode("homes").alias("b")).unionAll(across).where("a != b")
    roots = components(durable(edges.distinct(), "line-edges")).withColumnRenamed("node", "k")
    root = F.coalesce("root", "node")
    return out.join(roots, F.col("node") == F.col("k"), "left").withColumn("class", F.when(root <= NO_ID, root)).drop("homes", "node", "k", "root")


def dedup_lines(docs: DataFrame, edits: int = EDITS, classes: bool = True) -> DataFrame:
    """docs with __text (what stays of text) and __gone, __near, __linked, and, with classes, __class."""
    marks = marked_lines(docs, edits, classes)
    names = {"gone": "__gone", "near": "__near", "linked": "__linked", **({"class": "__class"} if classes else {}), "d": "__md", "th": "__mth"}
    marks = marks.select(*(F.col(a).alias(b) for a, b in names.items()))
    rows = docs.withColumns({"__d": order_id(F.col("doc_id")), "__th": F.xxhash64("text")})
    out = rows.join(marks, (F.col("__d") == F.col("__md")) & (F.col("__th") == F.col("__mth")), "left")
    lines = F.split("text", "\n", -1)
    gone = F.map_from_arrays(F.col("__gone"), F.col("__gone"))
    stays = let(gone, lambda g: F.array_join(F.filter(lines, lambda x, i: F.get(F.array(g[i]), F.lit(0)).isNull()), "\n"))
    text = F.when(F.col("__gone").isNull() | (F.size("__gone") == 0), F.col("text")).otherwise(stays)
    return out.withColumn("__text", text).drop("__d", "__th", "__md", "__mth")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(size("__gone")).cast("long").alias("n_removed"),
        F.when(F.col("__near").isNull(), F.lit(0)).otherwise(size("__near")).cast("long").alias("n_near"),
        F.coalesce(F.aggregate("__linked", F.lit(0).cast("long"), lambda a, x: a + x["links"]), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("__class", F.col("doc_id").cast("long")).alias("class_id"),
        F.sha2(F.coalesce("__text", F.lit("")), 256).alias("kept_sha256"),
    )


def keep_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that stay, and n_chars to match."""
    docs, names = masked(docs, ("doc_id", "text", "n_chars"))
    out = dedup_lines(docs, classes=False)
    chars = {"n_chars": F.char_length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unmasked(out.withColumns({"text": F.col("__text"), **chars}), names)
