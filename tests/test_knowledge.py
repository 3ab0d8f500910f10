"""Communities, threshold joins and canonical names against brute force."""

import itertools
import random

import numpy as np
import pytest
from tessera.operators import modularity as M
from tessera.operators.canonical import canonical_names, similar_sets, thresholds
from tessera.operators.graph import communities
from tessera.operators.threshold_join import cosine_pairs


def slow_q(edges, label):
    m = sum(w for _, _, w in edges)
    inner = sum(w for a, b, w in edges if label[a] == label[b])
    k = {}
    for a, b, w in edges:
        for x in (a, b):
            k[label[x]] = k.get(label[x], 0) + w
    return inner / m - sum(v * v for v in k.values()) / (4 * m * m)


def graph(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight double")


def labels_of(df):
    return {r["node"]: r["community"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_each_level_raises_modularity(spark, seed):
    rng = random.Random(seed)
    groups = [range(k * 9, k * 9 + 9) for k in range(5)]
    edges = [(a, b, rng.choice([1.0, 2.0])) for g in groups for a, b in itertools.combinations(g, 2) if rng.random() < 0.6]
    edges += [(rng.randrange(45), rng.randrange(45), 1.0) for _ in range(25)] + [(100, k, 1.0) for k in range(101, 130)] + [(7, 7, 2.0)]
    df = graph(spark, edges)
    found, history = M.merged(df)
    label = labels_of(found)
    assert set(label) == {x for e in edges for x in e[:2]}
    assert all(a < b for a, b in zip(history, history[1:], strict=False)) and len(history) > 2
    assert abs(history[-1] - slow_q(edges, label)) < 1e-9 and abs(M.modularity(df, found) - history[-1]) < 1e-9
    # no merge of two communities would raise it further
    names = sorted(set(label.values()))
    for a, b in itertools.combinations(names, 2):
        assert slow_q(edges, {k: a if v == b else v for k, v in label.items()}) <= history[-1] + 1e-9
    best = labels_of(M.modularity_communities(df))
    assert slow_q(edges, best) >= slow_q(edges, labels_of(communities(df))) - 1e-12


def test_small_graphs_reach_the_best_partition(spark):
    """Two cliques with one bridge: the best of all partitions is found."""
    edges = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a, b in itertools.combinations(g, 2)] + [(3, 4, 1.0)]

    def partitions(n):
        if n == 0:
            yield []
            return
        for p in partitions(n - 1):
            for c in range(max(p, default=-1) + 2):
                yield [*p, c]

    best = max(slow_q(edges, dict(enumerate(p))) for p in partitions(8))
    assert abs(M.modularity(graph(spark, edges), M.modularity_communities(graph(spark, edges))) - best) < 1e-9


def test_hub_and_no_edges(spark):
    star = graph(spark, [(0, k, 1.0) for k in range(1, 60)])
    found, history = M.merged(star)
    assert len(history) < 12 and abs(M.modularity(star, found) - history[-1]) < 1e-9
    none = graph(spark, []).limit(0)
    assert M.modularity_communities(none).count() == 0 and M.modularity(none, spark.createDataFrame([], "node long, community long")) == 0.0


@pytest.mark.parametrize("chunk", [4096, 20])
def test_cosine_pairs_lose_none(spark, chunk):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    x = np.concatenate([base[rng.integers(12, size=300)] + 0.25 * rng.normal(size=(300, 24)), rng.normal(size=(60, 24)), np.zeros((2, 24))])
    table = lambda rows: spark.createDataFrame([(int(k), [float(z) for z in x[k]]) for k in rows], "id long, v array<double>")
    left, right = table(range(0, 362, 2)), table(range(1, 362, 2))
    with np.errstate(invalid="ignore"):
        unit = np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))
    c = unit @ unit.T
    df = cosine_pairs(left, right, 0.85, chunk=chunk)
    got = {(r.left_id, r.right_id) for r in df.collect()}
    assert got == {(a, b) for a in range(0, 362, 2) for b in range(1, 362, 2) if c[a, b] > 0.85} and len(got) > 500
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert cosine_pairs(left.limit(0), right, 0.85).count() == 0 and cosine_pairs(left, right.limit(0), 0.85).count() == 0


def test_cells_are_visited_where_they_can_hold_a_pair(spark):
    """Tight clusters: a right vector is copied to few of the cells."""
    from unittest.mock import patch

    from tessera.operators import threshold_join

    rng, written = np.random.default_rng(4), {}
    x = rng.normal(size=(20, 32))[rng.integers(20, size=900)] + 0.02 * rng.normal(size=(900, 32))
    df = spark.createDataFrame([(k, [float(z) for z in v]) for k, v in enumerate(x)], "id long, v array<double>")
    plain = threshold_join.settle
    with patch.object(threshold_join, "settle", lambda d, name: written.setdefault(name, plain(d, name))):
        cosine_pairs(df, df, 0.9).count()
    assert written["cosine-visits"].count() < 900 * 6


def test_names(spark):
    rng, words = random.Random(5), [f"w{k}" for k in range(30)]
    rows = []
    for k in range(220):
        s = set(rng.sample(words[:9] if k % 2 else words, rng.randint(0, 7)))
        rows.append((k, rng.choice(["a", "b", None]), sorted(s)))
    df = spark.createDataFrame(rows, "id long, kind string, words array<string>")
    got = {r.id: r.canonical for r in canonical_names(df).collect()}
    up = {k: k for k, _, _ in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    sim = lambda a, b: len(a & b) / len(a | b)
    for kind in ("a", "b", None):
        sets = {}
        for k, q, w in rows:
            if q == kind and w:
                first = sets.setdefault(tuple(w), k)
                up[find(k)] = find(first)
        pairs = [(a, b, sim(set(x), set(y))) for (x, a), (y, b) in itertools.combinations(sets.items(), 2)]
        high = sorted(s for *_, s in pairs if s >= 0.7)
        if high:
            t = max(0.7, min(0.85, float(np.median(high))))
            for a, b, s in pairs:
                if s >= t:
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in up}
    pairs = similar_sets(df.dropDuplicates(["kind", "words"]))
    assert pairs.count() > 5 and all(0.7 <= r.threshold <= 0.85 for r in thresholds(pairs).collect())


def test_short_names_without_pairs(spark):
    """Groups of names that differ in one word: the same nodes as pair by pair, from rows that grow with the names."""
    from unittest.mock import patch

    from tessera.operators import canonical

    rng, words = random.Random(8), [f"w{k}" for k in range(40)]
    rows = [(k, "ab"[k % 2], sorted([*words[:7], f"x{k:03}"])) for k in range(80)]
    rows += [(100 + k, rng.choice(["a", "b", "c", None]), sorted(rng.sample(words[:10], rng.randint(0, 8)))) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, kind string, words array<string>")
    plain, written = canonical.settle, {}
    want = canonical_names(df).collect()
    with patch.object(canonical, "settle", lambda d, name: written.setdefault(name, plain(d, name))):
        got = canonical_names(df, longest=8).collect()
    assert sorted(got, key=lambda r: r.id) == sorted(want, key=lambda r: r.id)
    hub = {f"canonical-{x}": written[f"canonical-{x}"] for x in ("found", "links")}
    assert "canonical-pairs" not in written and all(d.where("dst < 100 AND src < 100").count() <= 80 for d in hub.values())
    distinct = df.where("size(words) > 0").groupBy("kind", "words").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    counted = canonical.grouped_links(distinct, canonical.alike_sizes(8, 0.7))[0]
    pairs = similar_sets(distinct).groupBy("kind", "sim").count()
    assert sorted(map(str, map(tuple, counted.collect()))) == sorted(map(str, map(tuple, pairs.collect())))
