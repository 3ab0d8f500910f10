"""Periodic run detection by the method of Kolpakov and Kucherov, over the words of a text.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(SHORTEST, EXPONENT * q) that no neighbouring word extends.

 0. Stretches. In such a run every window of SHORTEST - 1 words comes back one period
    earlier or later, so runs lie in stretches of words that are covered by windows which
    the text holds twice or more. Only these are searched, each on its own; what follows
    a stretch's end breaks its runs' periods, so they are the text's runs.
 1. Factors. A suffix automaton of the stretch keeps where each of its states ends first.
    From left to right, a factor is the longest piece that also begins earlier (the two
    may overlap), or one word that is new.
 2. Main's algorithm. A run that meets a factor's beginning reaches less than a period
    into what stands before the factor in front of it (that factor would have been longer
    otherwise). So for each boundary and each period that fits, the longest common
    extensions to both sides give the run; two Z functions find them for all periods.
 3. Copies. A run strictly inside a factor also stands in the factor's earlier place, with
    the same neighbours: it is copied from there.

All runs of a text are found: a stretch has no more of them than words. Work is linear in
the words but for sorting, memory is in proportion to the longest text; texts are read
once, without a shuffle.

Defined results: null and empty texts have no words and no runs. Words are compared
letter by letter, as they stand. Repeated rows are searched alike. A null doc_id takes no
tail (see `op13_runs`). Other columns are not touched, whatever their names; an empty
table gives no rows. Among longest runs the one that starts first is reported, then that
of the smaller period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import load

SHORTEST, EXPONENT = 6, 4
Run = tuple[int, int, int]


def stretches(codes: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Maximal stretches of at least `shortest` words that windows which occur twice or more cover."""
    width = shortest - 1
    n = len(codes) - width + 1
    if n < 2:
        return []
    mixed = codes[:n].copy()
    for k in range(1, width):  # equal windows have equal sums; different ones that agree too cost time, not runs
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += codes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    ends = np.flatnonzero(covered[1:] != covered[:-1])
    return [(a, b) for a, b in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True) if b - a >= shortest]


def first_ends(word: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Suffix automaton: the moves of its states, and the place where each state's strings end first."""
    moves: list[dict[int, int]] = [{}]
    longest, link, first = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(word):
        new = len(moves)
        moves.append({})
        longest.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy())
                longest.append(longest[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves, first


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, an earlier begin of the same words or -1) of each factor, from left to right."""
    moves, first = first_ends(word)
    out, i, n = [], 0, len(word)
    while i < n:
        state, j = 0, i
        while j < n:
            new = moves[state][word[j]]
            if first[new] >= j:  # these words end here first
                break
            state, j = new, j + 1
        out.append((i, j, first[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = max(j, i + 1)
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place, how far what begins there agrees with the beginning of s."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k > right - i:
                k = right - i
            if i + k < right:
                z[i] = k
                continue
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def meeting(word: list[int], lo: int, mid: int, hi: int, shortest: int, exponent: int) -> Iterator[Run]:
    """(start, end, a period) of stretches in word[lo:hi] that meet the boundary mid, keep the period to both sides, and are long enough; among them are all runs with periods that fit."""
    t, v = word[lo:mid], word[mid:hi]
    most = min((hi - lo) // exponent, max(len(t), len(v)))
    back = t[::-1]
    # how far the ends of word[:mid] and of what is shifted by a period agree, to the left and to the right of mid
    left = z_function([*back, -1, *v[:most][::-1]])
    right = z_function([*v, -1, *t[max(0, len(t) - most) :]])
    n, m = len(left), len(right)
    for p in range(1, most + 1):
        least = max(shortest, exponent * p) - p
        if p <= len(t):  # the period that ends at the boundary
            before = left[p] if p < len(t) else 0
            after = right[m - p]
            if after >= p:
                after = p + (right[p] if p < len(v) else 0)
            if before + after >= least:
                yield mid - p - before, mid + after, p
        if p <= len(v):  # the period that begins there; with a whole period before it, it is the first case's
            before = left[n - p]
            if before < p:
                after = right[p] if p < len(v) else 0
                if before + after >= least:
                    yield mid - before, mid + p + after, p


def runs_of(word: list[int], shortest: int = SHORTEST, exponent: int = EXPONENT, tally: dict[str, int] | None = None) -> list[Run]:
    """(start, end, smallest period) of all runs of a list of numbers >= 0, by start, then period."""
    n = len(word)
    found: dict[tuple[int, int], int] = {}
    at: dict[int, list[int]] = {}

    def add(start: int, end: int, period: int) -> None:
        old = found.get((start, end))
        if old is None:
            at.setdefault(start, []).append(end)
        if old is None or period < old:
            found[start, end] = period

    before = 0  # where the last factor begins
    for begin, end, source in [*factors(word), (n, n, -1)]:
        both = end - before
        reach = both // (exponent - 1)  # a period is shorter
        if both + reach >= shortest:
            for a, b, p in meeting(word, max(0, before - reach - 1), begin, end, shortest, exponent):
                if (a == 0 or word[a - 1] != word[a - 1 + p]) and (b == n or word[b] != word[b - p]):
                    add(a, b, p)
                    if tally is not None:
                        tally["met"] = tally.get("met", 0) + 1
        if source >= 0 and end - begin >= shortest + 2:
            shift = begin - source
            for s in range(source + 1, source + end - begin - shortest):
                for e in list(at.get(s, ())):
                    if e < source + end - begin:
                        add(s + shift, e + shift, found[s, e])
                        if tally is not None:
                            tally["copied"] = tally.get("copied", 0) + 1
        before = begin
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def text_runs(words: list[bytes], shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[Run]:
    """(start, end, smallest period) of the runs of a text's words."""
    if len(words) < shortest:
        return []
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for a, b in stretches(codes, shortest):
        number: dict[bytes, int] = {}
        out += [(s + a, e + a, p) for s, e, p in runs_of([number.setdefault(w, len(number)) for w in words[a:b]], shortest, exponent)]
    return out


def with_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """words, or for a tenth of the ids their beginning and a tail that repeats a piece of them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // p + 1))[: n - a]


def stays(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept: list[bytes] = []
    done = 0
    for a, b in sorted((s + q, e) for s, e, q in runs):
        if a > done:
            kept += words[done:a]
        done = max(done, b)
    return kept + words[done:]


def digest(words: list[bytes], runs: list[Run]) -> dict[str, int | str | None]:
    """What is reported of a text: its longest run, all runs, and the words that stay."""
    s, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
    size = None if s is None else e - s
    return {
        "n_runs": len(runs), "start": s, "length": size, "period": q, "exponent_milli": None if s is None else 1000 * size // q,
        "runs_sha256": hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(stays(words, runs))).hexdigest(),
    }


MINE = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def whole(words: list[bytes], runs: list[Run]) -> dict[str, list[dict[str, int]] | str]:
    """The runs, and the words without what repeats a run's first period, joined by a space."""
    return {"runs": [{"start": s, "length": e - s, "period": q} for s, e, q in runs], "collapsed": b" ".join(stays(words, runs)).decode("utf-8", "replace")}


def searched(docs: DataFrame, keep: list[str], mine: str, report: Callable[[list[bytes], list[Run]], dict[str, Any]], tails: bool) -> DataFrame:
    """Columns of `keep`, and what `report` says of each text's words and runs (columns `mine`)."""
    source = docs.select(F.col("text").alias("__text"), F.col("doc_id").cast("long").alias("__id"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)))
    own = T.StructType.fromDDL(mine)
    schema = T.StructType([*(T.StructField(f"k{n}", f.dataType) for n, f in enumerate(docs.select(*keep).schema.fields)), *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(f.name, to_arrow_type(f.dataType)) for f in own.fields]
        for b in batches:
            rows = []
            for text, doc_id in zip(b.column(0).cast(pa.binary()), b.column(1), strict=True):
                words = (text.as_py() or b"").split()  # of bytes: ASCII white space alone
                if tails:
                    words = with_tail(words, doc_id.as_py())
                rows.append(report(words, text_runs(words)))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *(pa.array([r[k] for r in rows], kind) for k, kind in kinds)], schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *own.names)


def collapse_runs(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of `keep`, runs (start, length and period of each), and collapsed, the text without repetitions. Columns of `keep` may have these names too."""
    return searched(docs, keep, "runs array<struct<start:long,length:long,period:long>>, collapsed string", whole, False)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(load(spark, sf_dir, "documents"), ["doc_id"], MINE, digest, True)
