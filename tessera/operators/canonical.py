"""Fuzzy canonicalisation: names of one kind whose word sets are alike get one representative.

Equal sets are one name first. Different ones meet by a prefix filter: words are put in
the order of how many names hold them, rare ones first, and two sets of a Jaccard
similarity of at least LEAST share one of their first (size - least overlap + 1) words.
So names meet over rare words, and only sets of sizes that allow the similarity.

Where sets are short, all that are alike are of sizes n >= m of which the smaller one lies
in the other, or n = m and they differ in one word each. Then no pairs are made at all:
sets meet in their parts of n - 1 words, each group of which is alike pair by pair and is
counted and linked to its first, and in whole smaller sets, of which a part finds one at
most. So rows grow with the sets, whatever a group's size.

A kind's threshold is the median similarity of its pairs from LEAST on, kept between LEAST
and MOST. Names linked at their kind's threshold, directly or in turn, are one node.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .graph import components

LEAST, MOST = 0.7, 0.85


def similar_sets(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(kind, a, b, sim), a < b, of different sets (kind, id, words: distinct) with a Jaccard similarity of at least `least`."""
    held = settle(sets.where(F.size("words") > 0).select(F.coalesce("kind", F.lit("")).alias("kind"), F.col("kind").isNull().alias("no_kind"), "id", "words"), "canonical-sets")
    words = held.select("kind", "no_kind", "id", F.size("words").alias("n"), F.explode("words").alias("word"))
    counts = words.groupBy("kind", "no_kind", "word").agg(F.count("*").alias("df"))
    ordered = words.join(counts, ["kind", "no_kind", "word"]).groupBy("kind", "no_kind", "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("o"))
    prefix = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int"))
    rows = settle(ordered.select("kind", "no_kind", "id", "n", F.explode(prefix).alias("p")).where("p.df > 1").select("kind", "no_kind", "id", "n", "p.word"), "canonical-prefixes")
    other = rows.select("kind", "no_kind", F.col("id").alias("b"), F.col("n").alias("m"), "word")
    fits = (F.col("id") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9)
    pairs = rows.join(other, ["kind", "no_kind", "word"]).where(fits).select("kind", "no_kind", F.col("id").alias("a"), "b").distinct()
    side = lambda x: held.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("i", F.size(F.array_intersect("wa", "wb")))
    sim = F.col("i") / (F.size("wa") + F.size("wb") - F.col("i"))
    return both.withColumn("sim", sim).where(F.col("sim") >= least).select(F.when(~F.col("no_kind"), F.col("kind")).alias("kind"), "a", "b", "sim")


def alike_sizes(longest: int, least: float) -> dict[tuple[int, int], float] | None:
    """Similarity by sizes (n, m), n >= m, of different sets that are alike; None if sets of up to `longest` words can be alike with fewer words in common than they can have."""
    out = {}
    for n in range(1, longest + 1):
        for m in range(1, n + 1):
            most, need = m - (m == n), ceil(least * (n + m) / (1 + least) - 1e-9)
            if need < most:
                return None
            if need == most and most / (n + m - most) >= least:
                out[n, m] = most / (n + m - most)
    return out


def grouped_links(sets: DataFrame, sizes: dict[tuple[int, int], float]) -> tuple[DataFrame, DataFrame]:
    """(kind, sim, n): how many pairs of sets (kind, id, words: distinct, sorted) have a similarity; (kind, sim, src, dst): links that join what these pairs do. No pairs are made."""
    parts = {n: sorted({m - (m == n) for k, m in sizes if k == n}) for n in {n for n, _ in sizes}}
    whole = {m for n, m in sizes if m < n}
    same = {n: sim for (n, m), sim in sizes.items() if m == n}
    # 128 bits of a kind and of words
    hashed = lambda w: (F.xxhash64("no", "kind", w), F.xxhash64(F.lit("set"), "no", "kind", w))
    places = F.lit(None).cast("array<array<int>>")
    for n, ts in parts.items():
        chosen = F.array(*(F.array(*map(F.lit, c)) for t in ts for c in combinations(range(n), t)))
        places = F.when(F.size("words") == n, chosen).otherwise(places)
    base = sets.withColumn("no", F.col("kind").isNull()).withColumn("n", F.size("words"))
    part = base.select("kind", "no", "id", "n", "words", F.explode(places).alias("c")).select("kind", "no", "id", "n", F.transform("c", lambda i: F.get(F.col("words"), i)).alias("w"))
    part = settle(part.select("kind", "id", "n", F.size("w").alias("t"), *(h.alias(f"h{k}") for k, h in enumerate(hashed(F.col("w"))))), "canonical-parts")

    def sim(n: Column, m: Column, of: dict[tuple[int, int], float]) -> Column:
        out = F.lit(None).cast("double")
        for (x, y), v in of.items():
            out = F.when((n == x) & (m == y), F.lit(v)).otherwise(out)
        return out

    n = F.col("n")
    one_off = part.where((F.col("t") == n - 1) & n.isin(*same))
    groups = one_off.groupBy("n", "h0", "h1").agg(F.count("*").alias("rows"), F.min("id").alias("src")).where("rows > 1")
    stars = one_off.join(groups, ["n", "h0", "h1"]).select("kind", sim(n, n, sizes).alias("sim"), "src", F.col("id").alias("dst"), "rows")
    own = base.where(n.isin(*whole)).select(n.alias("m"), F.col("id").alias("src"), *(h.alias(f"h{k}") for k, h in enumerate(hashed(F.col("words")))))
    inner = part.where(F.col("t") < n).join(own, ["h0", "h1"]).select("kind", sim(n, F.col("m"), {k: v for k, v in sizes.items() if k[0] > k[1]}).alias("sim"), "src", F.col("id").alias("dst"), F.lit(3).cast("long").alias("rows")).where("sim IS NOT NULL")
    found = settle(stars.unionByName(inner), "canonical-found")
    # each of a group's r rows is in r - 1 pairs, of two rows each; a row of a set in another one stands for a pair, like a group of two: 3 - 1 halves
    counted = found.groupBy("kind", "sim").agg(F.expr("sum(rows - 1) div 2").alias("n"))
    return counted, found.where("src != dst").select("kind", "sim", "src", "dst")


def thresholds(pairs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(kind, threshold) from the similarities of a kind's pairs: medians of counts by value, as sets of few words have few different similarities."""
    return medians(pairs.groupBy("kind", "sim").agg(F.count("*").alias("n")), least, most)


def medians(counted: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(kind, threshold) from how many pairs (n) a kind has of each similarity."""
    return counted.groupBy("kind").agg(F.greatest(F.lit(least), F.least(F.lit(most), F.percentile("sim", F.lit(0.5), F.col("n")))).alias("threshold"))


def canonical_names(names: DataFrame, least: float = LEAST, most: float = MOST, longest: int | None = None) -> DataFrame:
    """(id, kind, canonical): names (id: long, kind, words: distinct, sorted) and the smallest id of what each is one with; names without words stand alone.

    longest: most words that a name has, if that is known and small; the same result, without pairs.
    """
    rows = settle(names.select("id", "kind", "words"), "canonical-names")
    distinct = settle(rows.where(F.size("words") > 0).groupBy("kind", "words").agg(F.min("id").alias("id")), "canonical-distinct")
    sizes = alike_sizes(longest, least) if longest else None
    if sizes:
        counted, found = grouped_links(distinct, sizes)
        t = medians(counted, least, most)
    else:
        pairs = settle(similar_sets(distinct, least), "canonical-pairs")
        t, found = thresholds(pairs, least, most), pairs.withColumnsRenamed({"a": "src", "b": "dst"})
    t = t.withColumnRenamed("kind", "k")
    links = found.join(t, F.col("kind").eqNullSafe(F.col("k"))).where("sim >= threshold").select("src", "dst")
    ends = settle(links, "canonical-links")
    roots = components(ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), ends)
    named = distinct.join(roots, F.col("id") == F.col("node"), "left").select(F.col("kind").alias("k"), F.col("words").alias("w"), F.coalesce("component", "id").alias("canonical"))
    met = rows.join(named, F.col("kind").eqNullSafe(F.col("k")) & (F.col("words") == F.col("w")), "left")
    return met.select("id", "kind", F.coalesce("canonical", "id").alias("canonical"))
