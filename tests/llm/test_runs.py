"""Periodic runs against brute force, by parts and through the query."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import SparkSession
from tessera.llm.runs import collapse_runs, factors, first_ends, op13_runs, runs_of, stretches, text_runs, with_tail, z_function

SPACES = " \t\n\r\x0b\x0c"


def slow_runs(w, shortest=6, exponent=4):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        for s in range(len(w) - q):
            if w[s] == w[s + q] and (s == 0 or w[s - 1] != w[s - 1 + q]):
                e = s
                while e + q < len(w) and w[e] == w[e + q]:
                    e += 1
                e += q
                if e - s >= max(shortest, exponent * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                    out.add((s, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 3)):
        if w:
            a, p = rng.randrange(len(w)), rng.randint(1, 7)
            w[a:a] = w[a : a + p] * rng.randint(2, 7)
    if w and rng.random() < 0.4:  # a piece again, so that runs are copied
        a = rng.randrange(len(w))
        w += w[a : a + 30] + [9] + w[a : a + 30]
    return w


def test_runs_are_those_of_brute_force():
    rng, tally = random.Random(5), {}
    for _ in range(3000):
        w = made_up(rng)
        for shortest, exponent in ((6, 4), (4, 2)):
            assert runs_of(w, shortest, exponent, tally) == slow_runs(w, shortest, exponent), w
        assert text_runs([b"w%d" % c for c in w]) == slow_runs(w)
    assert tally["met"] > 1000 and tally["copied"] > 1000


def test_factors_are_longest_earlier_pieces():
    rng = random.Random(6)
    for _ in range(300):
        w, at = made_up(rng), 0
        for a, b, source in factors(w):
            assert a == at and b > a
            size = max((k for s in range(a) for k in range(1, len(w) - a + 1) if w[s : s + k] == w[a : a + k]), default=0)
            assert b - a == max(size, 1) and (source == -1 if not size else source < a and w[source : source + b - a] == w[a:b])
            at = b
        assert at == len(w)


def test_automaton_and_z():
    w = [1, 2, 1, 1, 2, 1]
    moves, first = first_ends(w)
    assert first[moves[moves[0][1]][2]] == 1 and z_function(w) == [6, 0, 1, 3, 0, 1]


def test_stretches_hold_what_comes_back():
    import numpy as np

    codes = np.array([hash(str(x)) for x in [*range(100, 120), *[1, 2] * 6, *range(200, 220)]], np.int64).view(np.uint64)
    assert stretches(codes) == [(20, 32)]
    assert stretches(codes[:4]) == []


@pytest.mark.parametrize("doc_id", range(40))
def test_tails(doc_id):
    words = [b"w%d" % i for i in range(37)]
    h = zlib.crc32(str(doc_id).encode())
    g, n, want = h // 10, 37, list(words)
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            want[i] = words[a + (i - a) % p]
    assert with_tail(words, doc_id) == want
    assert with_tail([], doc_id) == [] and with_tail(words, None) == words


def expected(doc_id, text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words = [w.decode() for w in with_tail([w.encode() for w in words], doc_id)]
    runs = slow_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query(spark: SparkSession, tmp_path):
    rng = random.Random(7)
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (4, "x y " * 9 + "\x0bz"), (5, "ü b c " * 30), (6, "one two three")]
    rows += [(i, " ".join("w%d" % c for c in made_up(rng))) for i in range(10, 90)] + [(90, "long words stand here " * 8000 + "end")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_runs string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_runs(spark, str(tmp_path)).collect()), key=str)
    assert zlib.crc32(b"90") % 10 and {r[0]: r for r in got}[90][1:5] == (1, 0, 32_000, 4)
    small = [(i, t) for i, t in rows if i != 90]
    assert [r for r in got if r[0] != 90] == sorted((expected(i, t) for i, t in small), key=str)


def test_own_interface(spark: SparkSession):
    df = spark.createDataFrame([("a", 1, "go on go on go on go on end", "x")], "runs string, doc_id long, text string, other string")
    (row,) = collapse_runs(df, ["runs", "doc_id"]).collect()
    assert row[0] == "a" and [tuple(r) for r in row[2]] == [(0, 8, 2)] and row[3] == "go on end"
    assert collapse_runs(df.limit(0), ["doc_id"]).count() == 0
