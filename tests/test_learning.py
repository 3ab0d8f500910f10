"""Ball tree, trained gate, layered embeddings, shapes and far points against brute force."""

import numpy as np
import pytest
from tessera.operators.ball_tree import build, search, visits
from tessera.operators.embeddings import layered, seeded_features, seeded_weights
from tessera.operators.gate import gradient, primes, proximal_step, soft_threshold, train
from tessera.operators.shapes import dominance, edgeworth, far_points
from tessera.operators.vectors import ball_distances


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.array([[0.5, 0, 0], [-0.5, 0.2, 0], [0, 0, 0.6], [0, -0.6, 0]])[rng.integers(4, size=n)] + 0.12 * rng.normal(size=(n, 3))
    return x / np.maximum(1, np.linalg.norm(x, axis=1, keepdims=True) / 0.95)


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(x)], "vec_id long, p array<double>")


def test_ball_tree_is_exact_and_sublinear(spark):
    seen = {}
    for n in (400, 1600):
        x = clustered(n)
        x[5:9] = x[4]  # equal points
        points = table(spark, x)
        tree = build(points, leaf=16)
        nodes = {r.node: r for r in tree.nodes.collect()}
        assert nodes[1].n == n and sum(r.n for r in nodes.values() if r.is_leaf) == n and all(r.n <= 16 for r in nodes.values() if r.is_leaf)
        for r in nodes.values():
            if not r.is_leaf:
                assert r.n == nodes[2 * r.node].n + nodes[2 * r.node + 1].n
        q = points.where("vec_id % 20 = 0").selectExpr("vec_id query_id", "p q")
        got = {}
        for r in search(tree, q, 5).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        d = ball_distances(x, x)
        for k in range(0, n, 20):
            d[k, k] = np.inf
            want = np.lexsort((np.arange(n), np.round(d[k], 12)))[:5]
            assert np.allclose(d[k, [v for _, v in sorted(got[k])]], d[k, want], atol=1e-9)
        leaves = visits(tree, q, 5).where("is_leaf").count() / (n // 20)
        seen[n] = leaves
    assert seen[1600] < 3 * seen[400] and seen[1600] < 30  # four times the leaves, of which there are about 128


def test_ball_tree_of_nothing_and_of_equal_points(spark):
    none = table(spark, np.zeros((0, 3))).limit(0)
    assert search(build(none), none.selectExpr("vec_id query_id", "p q"), 3).count() == 0
    same = table(spark, np.full((40, 2), 0.25))
    got = search(build(same, leaf=8), same.selectExpr("vec_id query_id", "p q"), 3).where("query_id = 7").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2] and all(r.d == 0 for r in got)


def gate_rows(spark, x, y):
    return spark.createDataFrame([([float(v) for v in r], int(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y int").repartition(3)


@pytest.mark.parametrize("penalty", [0.0, 0.02])
def test_gate_is_the_plain_fit(spark, penalty):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    y = (x[:, 1] - 0.5 * x[:, 3] + 0.3 * rng.normal(size=200) > 0).astype(int)
    w, history = train(gate_rows(spark, x, y), steps=12, penalty=penalty, extra=0.01, anchored=primes(7))
    plain = np.zeros(7)
    for step in range(12):
        p = 1 / (1 + np.exp(-(x @ plain[1:] + plain[0])))
        assert abs(history[step] - -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) < 1e-9
        g = np.concatenate([[(p - y).mean()], ((p - y)[:, None] * x).mean(0)])
        moved = plain - 0.5 * g
        for k in range(1, 7):
            t = 0.5 * (penalty + (0 if k in (2, 3, 5, 7) else 0.01))
            moved[k] = np.sign(moved[k]) * max(abs(moved[k]) - t, 0)
        plain = moved
    assert np.allclose(w, plain, atol=1e-9) and history[-1] < history[0]


def test_zeros_appear_as_the_penalty_grows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 8))
    rows = gate_rows(spark, x, (x[:, 2] > 0).astype(int))
    zeros = [int((train(rows, steps=10, penalty=p, anchored=range(1, 9))[0][1:] == 0).sum()) for p in (0.0, 0.05, 0.2)]
    assert zeros[0] == 0 and zeros[0] < zeros[1] <= zeros[2] and zeros[2] < 8
    assert train(rows.limit(0))[1] == []
    assert soft_threshold(np.array([-3.0, 0.5, 2.0]), 1.0).tolist() == [-2.0, 0.0, 1.0]
    w = np.zeros(3)
    assert proximal_step(w, gradient(np.ones((1, 2)), np.ones(1), w)[0], 1.0, 0.1, 0.3, [1])[1:].tolist() == pytest.approx([0.4, 0.1])


def test_layers_against_plain_sums(spark):
    edges = [(1, 2), (1, 3), (2, 3), (4, 1)]
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "node long")
    x = {r.node: np.array(r.x) for r in seeded_features(nodes, 3).collect()}
    layers = [seeded_weights(4, 6, 1), seeded_weights(2, 8, 2)]
    got = {r.node: np.array(r.x) for r in layered(e, seeded_features(nodes, 3), layers).collect()}
    near = {k: [b for a, b in edges if a == k] + [a for a, b in edges if b == k] for k in x}
    for n, w in enumerate(np.array(m) for m in layers):
        new = {}
        for k, v in x.items():
            h = np.concatenate([v, np.mean([x[j] for j in near[k]], axis=0) if near[k] else np.zeros(len(v))])
            new[k] = np.maximum(w @ h, 0) if n == 0 else w @ h / (np.linalg.norm(w @ h) or 1)
        x = new
    assert all(np.allclose(got[k], x[k]) for k in x) and len(got) == 5


def nearest_in(project, feasible, y, rng):
    """A projection x of y onto a convex cone: feasible, and no feasible z lies further on towards y."""
    x = project(y)
    assert feasible(x, 1e-6)
    for _ in range(40):
        z = project(y + rng.normal(size=y.shape) * 2)
        assert ((y - x) * (z - x)).sum() <= 1e-4
    return x


def test_ordered_cones():
    rng = np.random.default_rng(4)
    cross = lambda g: g[1:, 1:] - g[1:, :-1] - g[:-1, 1:] + g[:-1, :-1]
    for _ in range(8):
        y = rng.normal(size=(3, 4))
        nearest_in(edgeworth, lambda g, e: (cross(g) >= -e).all(), y, rng)
        pair = rng.normal(size=(2, 5))
        nearest_in(lambda v: np.stack(dominance(v[0], v[1])), lambda v, e: (np.diff(v[0]) - np.diff(v[1]) >= -e).all(), pair, rng)
    fine = np.outer([0.0, 1, 2], [0.0, 1, 3])
    assert np.allclose(edgeworth(fine), fine)


def test_far_points_are_greedy(spark):
    x = clustered(120, 5)
    got = [(r.vec_id, r.d) for r in far_points(table(spark, x).repartition(3), 8, ball_distances).orderBy("rank").collect()]
    d, want = ball_distances(x, x), [0]
    while len(want) < 8:
        want.append(int(d[want].min(axis=0).argmax()))
    assert [v for v, _ in got] == want and all(abs(far - d[want[:k], v].min()) < 1e-9 for k, (v, far) in enumerate(got) if k)
    assert far_points(table(spark, x[:3]), 8, ball_distances).count() == 3 and far_points(table(spark, x).limit(0), 3, ball_distances).count() == 0


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_routing_finds_the_nearest_occupied_cells(spark, spread):
    from tessera.operators.blocks import e8_nearest
    from tessera.operators.lattice import folded, key, route_cells, shells

    v = shells()
    assert len({tuple(r) for r in v}) == len(v) == 1 + 240 + 2160 and np.array_equal(e8_nearest(v), v) and set((v * v).sum(1)) == {0, 2, 4}
    x = spread * np.random.default_rng(6).normal(size=(150, 12))
    df = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "vec_id long, v array<double>")
    y = folded(x)
    points = {c: p for c, p in zip(key(e8_nearest(y)), e8_nearest(y), strict=True)}
    got = {}
    for r in route_cells(df.where("vec_id < 30"), df, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.cell))
    for k in range(30):
        d = {c: round(float(np.linalg.norm(y[k] - p)), 9) for c, p in points.items()}
        assert [c for _, c in sorted(got[k])] == sorted(d, key=lambda c: (d[c], c))[:3]
