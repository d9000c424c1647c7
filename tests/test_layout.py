"""Label layout and outlines against plain loops and geometry."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import layout as L
from loomtext.operators import outlines as O


def plain_layout(rows, sx, sy):
    kept, room = [], L.PADDING * max(sx, sy)
    box = lambda r: (r[2] - 0.5 * max(len(r[1]), 1) * L.CHARACTER * sx, r[2] + 0.5 * max(len(r[1]), 1) * L.CHARACTER * sx, r[3] - 0.5 * L.LINE * sy, r[3] + 0.5 * L.LINE * sy)
    for r in sorted(rows, key=lambda r: (r[0], -r[4], r[1], r[2], r[3])):
        a = box(r)
        if not any(k[0] == r[0] and not (a[1] + room < b[0] or b[1] + room < a[0] or a[3] + room < b[2] or b[3] + room < a[2]) for k, b in kept):
            kept.append((r, a))
    return sorted(r for r, _ in kept)


@pytest.mark.parametrize("rest", [2000, 3])
def test_layout_is_that_of_the_sequential_loop(spark, monkeypatch, rest):
    monkeypatch.setattr(L, "REST", rest)
    rng = random.Random(rest)
    rows = [(k % 2, "w" * rng.randint(0, 30), rng.gauss(0, 1.5), rng.gauss(0, 1.5), float(rng.randint(1, 9))) for k in range(160)] + [(0, "same", 5.0, 5.0, 7.0)] * 4
    df = spark.createDataFrame(rows, "level int, text string, x double, y double, priority double")
    got = sorted(tuple(r) for r in L.without_overlaps(df, 6.0, 4.0).collect())
    assert got == plain_layout(rows, 6.0, 4.0) and 20 < len(got) < 150
    assert L.without_overlaps(df.limit(0), 6.0, 4.0).count() == 0
    odd = spark.createDataFrame([(None, "a", 0.0, 0.0, 1.0), (0, None, 0.0, 0.0, 1.0), (0, "b", None, 0.0, 1.0)], df.schema)
    assert L.without_overlaps(odd, 1.0, 1.0).count() == 0


def test_two_levels_of_labels(spark):
    texts = {(1, 0): "apple pear apple", (1, 1): "plum cherry plum", (2, 0): "north wind", (3, 0): "x1 y1", (3, 1): ""}
    rows = [(c, s, float(c), float(s), t) for (c, s), t in texts.items() for _ in range(3)] + [(-1, 0, 9.0, 9.0, "noise words")]
    points = spark.createDataFrame(rows, "cluster_id int, sub_id int, x double, y double, body string")
    names = spark.createDataFrame([(1, "Fruit"), (3, "X1, X1 Y1")], "cluster_id int, label string")
    got = {(r.cluster_id, r.sub_id, r.level): r for r in L.two_level_labels(points, names, "body").collect()}
    assert {k: v.text for k, v in got.items() if k[2] == 0} == {(1, None, 0): "Fruit", (2, None, 0): "Cluster 2", (3, None, 0): "X1, X1 Y1"}
    # cluster 2 is one part; of cluster 3 one part has no term, the other's label is the cluster's
    assert {k for k in got if k[2] == 1} == {(1, 0, 1), (1, 1, 1)}
    assert got[1, 0, 1].text.startswith("apple") and got[1, 1, 1].text.startswith("plum") and got[1, 0, 1].priority == 3.0 and got[1, 1, 1].y == 1.0


def test_triangulation_is_delaunay():
    rng = np.random.default_rng(3)
    for points in (rng.normal(size=(60, 2)), np.stack(np.meshgrid(np.arange(6.0), np.arange(5.0)), -1).reshape(-1, 2)):
        tri = O.triangles(points)
        hull = O._chain(points)
        area = sum(O._area(points[t]) for t in tri)
        assert all(O._area(points[t]) > -1e-6 for t in tri) and abs(area - O._area(hull)) < 1e-4 * area
        centre, r = O._circles(points, tri[[O._area(points[t]) > 1e-6 for t in tri]])
        assert all((((points - c) ** 2).sum(1) > q - 1e-4 * max(q, 1)).all() for c, q in zip(centre, r))


def test_outlines_follow_a_bow(spark):
    rng = random.Random(7)
    bow = [(1, (2 + rng.uniform(-0.2, 0.2)) * math.cos(a), (2 + rng.uniform(-0.2, 0.2)) * math.sin(a)) for a in [k * 1.5 * math.pi / 1500 for k in range(1500)]]
    square = [(2, 10 + rng.random(), rng.random()) for _ in range(500)]
    rows = bow + square + [(3, float(k), float(k)) for k in range(6)] + [(4, 0.0, 0.0)] * 9 + [(5, 0.0, 1.0)] * 2 + [(-1, 0.0, 0.0)] * 9 + [(1, None, 0.0), (1, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "cluster_id int, x double, y double")
    got = {r.cluster_id: np.array(r.path) for r in O.outlines(df, radius=0.5, smooth=0).collect()}
    assert set(got) == {1, 2, 3, 4}
    for c in (1, 2):
        own = np.array([r[1:] for r in rows if r[0] == c and r[1] is not None and r[1] == r[1]], float)
        diagonal = float(np.hypot(*(np.ptp(own, axis=0) / O.CELLS)))
        assert O.holds(got[c], own, diagonal).all()
    hull = O._area(O._chain(np.array([r[1:] for r in bow])))
    assert O._area(got[1]) < 0.6 * hull and not O.holds(got[1], np.array([[0.0, 0.0]]), 0.1).any()
    assert abs(O._area(got[2])) > 0.9
    assert len(got[3]) <= 2 and len(got[4]) == 1
    smooth = {r.cluster_id: r.path for r in O.outlines(df, smooth=2).collect()}
    assert len(smooth[2]) % 4 == 0 and O.outlines(df.limit(0)).count() == 0
