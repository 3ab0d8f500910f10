"""The n-gram Jaccard join against all pairs, with whole cells and with cells cut small."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import jaccard
from tessera.llm.jaccard import cell_links, cells_of, ngrams, op11_jaccard, similar


def shingles(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if c.isascii() else c
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


class Classes:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def slow(rows):
    sets, c = [shingles(t) for _, t in rows], Classes()
    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]):
                c.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[c.find(k)] = min(i, least.get(c.find(k), i))
    return sorted(((i, len(sets[k]), least.get(c.find(k))) for k, (i, _) in enumerate(rows)), key=str)


WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "en", "or", "üs")]


def made_up(seed):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    families = [[rng.choice(WORDS) for _ in range(rng.randint(20, 120))] for _ in range(8)]
    rows = []
    for k in range(260):
        words = list(rng.choice(families)) if k % 3 else [rng.choice(WORDS) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        text = " ".join(words)
        rows.append((k, text + "\n" + passage if k % 4 == 0 else text.title() if k % 7 == 0 else text))
    rows += [(300, None), (301, ""), (302, " \t "), (303, "one"), (304, "ONE"), (305, "two words"), (306, "É b c d e f"), (307, "é b c d e f")]
    rows += [(None, rows[0][1]), (400, "only here in these two rows"), (400, "only here in these two rows"), (None, "a row without any number at all"), (401, passage)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n long, s1 long, id long")


@pytest.mark.parametrize("cell", [1 << 20, 400])
def test_all_links(spark, cell):
    rows = made_up(1)
    assert sorted(map(tuple, similar(table(spark, rows), cell=cell).collect()), key=str) == slow(rows)


def test_query(spark, tmp_path):
    rows = made_up(2)
    base = [f"w{k}" for k in range(40_000)]
    long = [(500, " ".join(base)), (501, " ".join([*base[:30_000], "x", *base[30_001:]]))]
    table(spark, rows + long).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_jaccard(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and [t for _, t in got.dtypes] == ["bigint"] * 3
    out = sorted(map(tuple, got.collect()), key=str)
    assert [r for r in out if r[0] not in (500, 501)] == slow(rows)
    assert [r for r in out if r[0] in (500, 501)] == [(500, 39_996, 500), (501, 39_996, 500)]


def test_empty_table(spark):
    assert similar(table(spark, []).limit(0)).count() == 0


def test_ngrams_are_distinct():
    assert len(ngrams(None)) == len(ngrams(b" \n")) == 0 and len(ngrams(b"a b")) == 1
    assert len(ngrams(b"a b c d e " * 50)) == 5 and (ngrams(b"A b c d e f") == ngrams(b"a B c\td e f")).all()


def test_trees_find_what_pairs_do():
    rng, tally = random.Random(3), Counter()
    for _ in range(500):
        m, two = rng.randint(1, 25), rng.random() < 0.5
        base = [rng.sample(range(60), rng.randint(3, 30)) for _ in range(4)]
        sets = [np.array(sorted(set(rng.choice(base)) ^ set(rng.sample(range(60), rng.randint(0, 4))) | {rng.randrange(60)}), np.int64) for _ in range(m)]
        sizes = [len(s) + (rng.random() < 0.2) for s in sets]
        labels = [rng.choice([k, k, k % 3]) for k in range(m)]
        sides = [int(two and k % 3 == 0) for k in range(m)]
        true = {(a, b) for a in range(m) for b in range(a) if (not two or sides[a] != sides[b]) and 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (sizes[a] + sizes[b])}
        got = cell_links(sets, sizes, labels, sides, tally=tally)
        assert all((max(x), min(x)) in true for x in got)
        want, have = Classes(), Classes()
        for c, links in ((want, true), (have, got)):
            for a, b in [*links, *((k, 100 + labels[k]) for k in range(m))]:
                c.join(a, b)
        assert [want.find(k) for k in range(m)] == [have.find(k) for k in range(m)]
    assert tally["pruned by rest"] > 1000 and tally["pruned by size"] > 100


def test_cells_hold_every_pair_of_two_classes(spark):
    members = [(7, k, k % 5 if k < 300 else 1000 + k, 3) for k in range(420)] + [(8, k, 1, 3) for k in range(50)]
    cells = cells_of(spark.createDataFrame(members, "unit long, id long, label long, n int"), 90).collect()
    met, size = set(), Counter()
    by = {}
    for r in cells:
        by.setdefault((r.unit, r.i, r.j), []).append(r)
        assert r.unit == 7
    for rows in by.values():
        size[len(rows)] += 1
        sides = [[r for r in rows if r.side == s] for s in (0, 1)]
        met |= {frozenset((a.id, b.id)) for a in sides[0] for b in (sides[1] or sides[0]) if a.label != b.label}
    label = {i: lab for u, i, lab, _ in members if u == 7}
    assert met == {frozenset((a, b)) for a in label for b in label if label[a] != label[b]}
    assert max(size) < 150


def test_no_pairs_within_a_group(spark, monkeypatch):
    """Two hundred near copies of one text give links by their number, not by pairs."""
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(k) for k in range(100)]
    rows = [(k, " ".join([*base[:k], "other", *base[k:]]) if k < 100 else " ".join([*base, "end", str(k)])) for k in range(200)]
    docs = table(spark, rows).select("doc_id", "text")
    found = jaccard.links(docs, jaccard.sets_of(docs))
    assert found.count() < 200 * 4
    assert similar(docs).agg(F.count_distinct("component_id")).first()[0] == len({r[2] for r in slow(rows)})
