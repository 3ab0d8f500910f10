"""The conversation trie against brute force over tuples of turns, in one cell and in many."""

import hashlib
import random
import zlib

import pytest
from tessera.llm import conversation_trie as ct
from tessera.llm.conversation_trie import UNIT, LoserTree, conversation_trie, op12_conversation_trie, rebuilt, sorted_run, trie, units

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_trie(sequences):
    """sequences: conv_id -> tuple of (role, text)."""
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0 if p in kids else 1), ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        for k in kids.get(p, ()):
            x, y = below(k)
            leaves, saved = leaves + x, saved + y
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def slow_rebuilt(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, ())[: h[c]] + s[h[c] :] for c, s in own.items()}


def made_up(seed, n=400, long=0):
    rng, rows = random.Random(seed), []
    for c in range(n):
        like = random.Random(c % 7 if c % 3 else c)
        rows += [(c, t, like.choice(["user", "assistant", None]), like.choice(["", None, "yes", "no ü", "a longer turn " * 3])) for t in range(like.randint(0, 7))]
        rows += [(c, None, "system", "first")] * (c % 11 == 0)
    rows += [(n, t, "user", f"turn {t % 5}") for t in range(long)] + [(n + 1, t, "user", f"turn {t % 5}") for t in range(long)]
    rows += [(None, 1, "user", "no conversation")] * 3
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, run long, cell string")


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [(1 << 25, 1 << 24), (900, 600), (40, 100)])
def test_trie(spark, sizes):
    rows = made_up(1, long=60)
    assert result(trie(rebuilt(units(table(spark, rows))), *sizes)) == slow_trie(slow_rebuilt(rows))


def test_hot_copies_over_many_cells(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1500) for t in range(3)] + [(c, t, "user", f"same {t}") for c in range(2000, 2030) for t in range(c % 6)]
    turns = {c: tuple(("user", f"same {t}") for t in range(3 if c < 1500 else c % 6)) for c in {r[0] for r in rows}}
    assert result(trie(units(table(spark, rows)), 500, 2000)) == slow_trie(turns)


def test_query(spark, tmp_path):
    rows = made_up(2, n=250, long=9)
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_conversation_trie(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert result(got) == slow_trie(slow_rebuilt(rows))


def test_edges(spark):
    none = table(spark, made_up(3, 10)).limit(0)
    assert conversation_trie(none).count() == 0
    lost = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)  # its one turn is replaced by an absent one
    (root,) = result(trie(rebuilt(units(table(spark, [(lost, 0, "user", "gone")])))))
    assert root[:7] == (lost, 0, None, 1, 0, 1, 0)
    long = slow_trie({1: (("u", "x" * 300_000),) * 2})
    assert result(conversation_trie(table(spark, [(1, 0, "u", "x" * 300_000)] * 2))) == long


def test_merge_looks_at_no_shared_turn_twice():
    rng = random.Random(4)
    unit = lambda k: hashlib.sha256(b"%d" % k).digest()[:UNIT]
    start = b"".join(unit(k) for k in range(50))
    items = [(start + b"".join(unit(rng.randrange(3)) for _ in range(rng.randint(0, 6))), c) for c in range(600)]
    rng.shuffle(items)
    tree = LoserTree([sorted_run(items[k::9]) for k in range(9)])
    merged = list(tree)
    assert [(s, c) for s, c, _ in merged] == sorted(items)
    assert all(n == ct.common(a[0], b[0]) for a, b, n in zip(merged, merged[1:], [m[2] for m in merged[1:]], strict=False))
    assert tree.compared < 600 * 4 * 5 + 9 * 60  # a plain merge looks at 50 and more each time
    assert list(LoserTree([])) == [] and list(LoserTree([[], sorted_run([(b"", 3)])])) == [(b"", 3, 0)]
