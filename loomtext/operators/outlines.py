"""Concave outlines of clusters: alpha shapes of reduced points.

A cluster's points are reduced to the outermost ones of each cell of a grid over its box, in one aggregation; what is
left is of fixed size, so a task triangulates it whole. Triangles with a circumcircle wider than the cluster's spread
are left out, and the rest's outer edge is the outline; the width doubles until one outline holds all reduced points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import NOISE, _chain

#: Cells of the grid along each axis; at most four points of each stay.
CELLS = 16


def triangles(points: np.ndarray) -> np.ndarray:
    """Corners of a Delaunay triangulation, counter-clockwise: points are put in one by one, and the triangles whose circumcircle has the new one give way to those with it."""
    n = len(points)
    middle, span = points.mean(0), max(float(np.ptp(points, axis=0).max()), 1e-12)
    # a shift too small to be seen keeps points off a common circle or line
    shift = np.random.default_rng(0).uniform(-1e-7, 1e-7, points.shape)
    p = np.concatenate(((points - middle) / span + shift, [[-60.0, -50.0], [60.0, -50.0], [0.0, 80.0]]))
    tri = np.array([[n, n + 1, n + 2]])
    centre, radius = _circles(p, tri)
    for k in range(n):
        inside = ((p[k] - centre) ** 2).sum(1) < radius
        edges = np.concatenate([tri[inside][:, [i, (i + 1) % 3]] for i in range(3)])
        have = set(map(tuple, edges.tolist()))
        rim = np.array([(a, b) for a, b in have if (b, a) not in have])
        new = np.column_stack((rim, np.full(len(rim), k)))
        c, r = _circles(p, new)
        tri, centre, radius = np.concatenate((tri[~inside], new)), np.concatenate((centre[~inside], c)), np.concatenate((radius[~inside], r))
    return tri[(tri < n).all(1)]


def _circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of the triangles' circumcircles."""
    a, b, c = (p[tri[:, i]] for i in range(3))
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    d = np.where(np.abs(d) < 1e-300, 1e-300, d)
    uu, vv = (u**2).sum(1), (v**2).sum(1)
    off = np.column_stack(((v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d))
    return a + off, (off**2).sum(1)


def rings(tri: np.ndarray) -> list[list[int]]:
    """The closed chains of edges that only one triangle has; around outer edges counter-clockwise."""
    third = {(int(t[i]), int(t[(i + 1) % 3])): int(t[(i + 2) % 3]) for t in tri for i in range(3)}
    left = {e for e in third if e[::-1] not in third}
    out = []
    while left:
        start = e = min(left)
        ring = []
        while e in left:
            left.discard(e)
            ring.append(e[0])
            u, v = e
            w = third[u, v]
            while (w, v) in third:  # on around v, from triangle to triangle, to the next outer edge
                w = third[w, v]
            e = (v, w)
        if e == start:
            out.append(ring)
    return out


def _area(ring: np.ndarray) -> float:
    x, y = ring.T
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2)


def holds(ring: np.ndarray, points: np.ndarray, room: float) -> np.ndarray:
    """Which points lie inside a ring or within ``room`` of it."""
    a, b = ring, np.roll(ring, -1, axis=0)
    x, y = points[:, 0][:, None], points[:, 1][:, None]
    over = (a[:, 1] > y) != (b[:, 1] > y)
    rise = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
    crossed = (over & (x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / rise)).sum(1) % 2 == 1
    side = b - a
    along = np.clip(((points[:, None] - a) * side).sum(2) / np.maximum((side**2).sum(1), 1e-300), 0, 1)
    away = np.sqrt(((a + along[:, :, None] * side - points[:, None]) ** 2).sum(2)).min(1)
    return crossed | (away <= room)


def alpha_shape(points: np.ndarray, radius: float) -> np.ndarray | None:
    """The outline of the triangles with a circumradius up to ``radius``, or up to the first double of it with which one outline holds all points; None if only the convex one does."""
    tri = triangles(points)
    if not len(tri):
        return None
    wide = np.sqrt(_circles(points, tri)[1])
    room = 1e-6 * max(float(np.ptp(points, axis=0).max()), 1e-12)
    while (wide > radius).any():
        some = rings(tri[wide <= radius])
        if some:
            ring = points[max(some, key=lambda r: _area(points[r]))]
            if len(np.unique(ring, axis=0)) == len(ring) and holds(ring, points, room).all():
                return ring
        radius *= 2
    return None


def smoothed(path: np.ndarray, times: int) -> np.ndarray:
    """Corners cut at a quarter of both sides, again and again."""
    for _ in range(times):
        after = np.roll(path, -1, axis=0)
        path = np.stack((0.75 * path + 0.25 * after, 0.25 * path + 0.75 * after), 1).reshape(-1, 2)
    return path


def _outline(smooth: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(g[["x", "y"]].to_numpy(float), axis=0)
        radius = float(g["radius"].iloc[0])
        path = alpha_shape(points, radius) if len(points) > 3 else None
        path = _chain(points) if path is None else path
        return pd.DataFrame({"cluster_id": [int(g["cluster_id"].iloc[0])], "path": [smoothed(path, smooth).tolist() if len(path) > 2 else path.tolist()]})
    return run


def outlines(points: DataFrame, radius: float | None = None, smooth: int = 2, least: int = 4, cells: int = CELLS) -> DataFrame:
    """(cluster_id, path): a ring around each cluster of ``least`` points or more, of points (cluster_id, x, y); noise has none.

    ``radius``: of the widest circumcircle, by default the cluster's spread (0.25 at least). Every point lies inside the
    ring or within a cell's diagonal of it, before corners are cut ``smooth`` times. Where only the convex outline holds
    all points it is that; points on one line give a line. Points with a null or non-finite coordinate take no part.
    """
    finite = "cluster_id is not null and x between -1e300 and 1e300 and y between -1e300 and 1e300"
    own = points.filter((F.col("cluster_id") != NOISE) & F.expr(finite)).select(F.col("cluster_id").cast("int"), F.col("x").cast("double"), F.col("y").cast("double"))
    ends = [f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))]
    spread = F.greatest(F.sqrt(F.var_pop("x") + F.var_pop("y")) + 1e-6, F.lit(0.25)) if radius is None else F.lit(float(radius))
    size = own.groupBy("cluster_id").agg(F.count("*").alias("_n"), spread.alias("radius"), *ends).filter(F.col("_n") >= least)
    met = own.join(size, "cluster_id")
    cell = [F.floor((F.col(c) - F.col(f"_low{c}")) / F.greatest(F.col(f"_high{c}") - F.col(f"_low{c}"), F.lit(1e-300)) * (cells * (1 - 1e-9))) for c in ("x", "y")]
    # the outermost points of each cell, in one aggregation of a few values
    outer = [f(F.struct(a, b)).alias(f"_{n}{a}") for a, b in (("x", "y"), ("y", "x")) for n, f in (("least", F.min), ("most", F.max))]
    kept = met.groupBy("cluster_id", "radius", cell[0].alias("_cx"), cell[1].alias("_cy")).agg(*outer)
    some = F.array(*[F.struct(F.col(f"_{n}{a}.x").alias("x"), F.col(f"_{n}{a}.y").alias("y")) for a in ("x", "y") for n in ("least", "most")])
    few = kept.select("cluster_id", "radius", F.explode(F.array_distinct(some)).alias("p")).select("cluster_id", "radius", "p.x", "p.y")
    return few.groupBy("cluster_id").applyInPandas(_outline(smooth), "cluster_id int, path array<array<double>>")
