"""Density clusters: planted groups, invariants, and the tree against a plain form."""

import random

import numpy as np
import pytest

from loomtext.operators import cluster as K
from loomtext.operators import density as D


def blob(rng, x, y, width, n):
    return [(x + rng.gauss(0, width), y + rng.gauss(0, width)) for _ in range(n)]


def agreement(a, b):
    """Rand index of two labelings."""
    a, b = np.asarray(a), np.asarray(b)
    return ((a[:, None] == a) == (b[:, None] == b)).mean()


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(1)
    at = rng.normal(size=(60, 2))
    core = D.cores(at, np.ones(60, int), np.zeros(60), 5)
    d = np.sqrt(((at[:, None] - at) ** 2).sum(2))
    assert np.allclose(core, np.sort(d, 1)[:, 4])
    reach = np.maximum(np.maximum(core[:, None], core), d)
    root, total = list(range(60)), 0.0
    for w, i, j in sorted((reach[i, j], i, j) for i in range(60) for j in range(i)):  # Kruskal
        if root[i] != root[j]:
            total, root = total + w, [root[i] if x == root[j] else x for x in root]
    assert abs(sum(w for w, _, _ in D.spanning_tree(at, core)) - total) < 1e-9


def test_two_densities_side_by_side(spark):
    rng = random.Random(5)
    groups = [blob(rng, 0, 0, 0.02, 300), blob(rng, 0.35, 0, 0.02, 300), blob(rng, 6, 0, 1.0, 300)]
    noise = [(rng.uniform(-40, 40), rng.uniform(10, 60)) for _ in range(25)]
    rows = [(k, float(x), float(y), c) for c, g in enumerate([*groups, noise]) for k, (x, y) in enumerate(g)]
    df = spark.createDataFrame(rows, "k int, x double, y double, planted int").repartition(4)
    for most in (4096, 4 * 925, 300):
        got = D.density_clusters(df, 30, 5, most).collect()
        assert len(got) == len(rows)
        for c in range(3):
            own = [r.cluster_id for r in got if r.planted == c]
            main = max(set(own), key=own.count)
            assert main >= 0 and own.count(main) > 0.85 * len(own), (most, c)
        assert len({max(set(o), key=o.count) for o in ([r.cluster_id for r in got if r.planted == c] for c in range(3))}) == 3
        assert sum(r.cluster_id == -1 for r in got if r.planted == 3) >= 20
        sizes = [sum(r.cluster_id == c for r in got) for c in range(max(r.cluster_id for r in got) + 1)]
        assert min(sizes) >= 30 and sizes == sorted(sizes, reverse=True)
    # a grid of one level keeps the close pair together, or loses the wide group
    one = K.grid_density(df).collect()
    pair = [{r.cluster_id for r in one if r.planted == c} - {-1} for c in (0, 1)]
    wide = [r.cluster_id for r in one if r.planted == 2]
    assert pair[0] & pair[1] or max(wide.count(c) for c in set(wide)) < 0.85 * len(wide)


def test_invariants(spark):
    rng = random.Random(6)
    points = blob(rng, 0, 0, 1, 120) + blob(rng, 9, 1, 0.3, 80) + [(rng.uniform(-9, 20), rng.uniform(-9, 9)) for _ in range(15)]
    at = np.array(points)
    ones, none = np.ones(len(at), np.int64), np.zeros(len(at))
    base = D.stable_clusters(at, ones, none, 15, 5)
    assert {0, 1} <= set(base.tolist()) and all((base == c).sum() >= 15 for c in set(base.tolist()) - {-1})
    order = np.array(rng.sample(range(len(at)), len(at)))
    assert agreement(D.stable_clusters(at[order], ones, none, 15, 5), base[order]) == 1
    assert agreement(D.stable_clusters(at * 37 + 5, ones, none, 15, 5), base) == 1
    # repeated points weigh as bubbles do
    twice = D.stable_clusters(np.repeat(at, 2, axis=0), np.ones(2 * len(at), np.int64), np.zeros(2 * len(at)), 30, 10)
    weighed = D.stable_clusters(at, ones * 2, none, 30, 10)
    assert agreement(twice, np.repeat(weighed, 2)) > 0.999


@pytest.mark.parametrize("rows", [[], [(1.0, 1.0)], [(1.0, 1.0)] * 30, [(None, 1.0), (float("nan"), 2.0), (3.0, float("inf"))], [(float(k), 0.0) for k in range(5)]])
def test_edge_tables(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double").selectExpr("x", "y", "'b' as bubble_of", "1 as n")
    got = D.density_clusters(df).collect()
    assert len(got) == len(rows) and all(set(r.asDict()) == {"x", "y", "bubble_of", "n", "cluster_id"} for r in got)
    assert {r.cluster_id for r in got} <= ({0} if len(rows) == 30 else {-1})
