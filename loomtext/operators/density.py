"""Density clusters of points in a plane: mutual reachability, its spanning tree, and the tree's most stable branches.

Points are first gathered in bubbles: cells of a quadtree that is finer where points are dense, with their number, mean
and spread. Their number has a bound that doesn't grow with the points (of few points, each is a bubble of its own, and
the result is that of the points themselves), so one task holds them all, spans the tree and cuts it; the labels go back
to the points by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import NOISE
from .store import written

#: How often a cell may be quartered.
DEPTH = 20
#: A cell of more than a quarter of this share of all points is quartered.
BUBBLES = 4096


def bubbles(points: DataFrame, most: int = BUBBLES) -> tuple[DataFrame, DataFrame]:
    """``points`` (x, y, ...) with their ``bubble``, and the bubbles (bubble, n, x, y, spread): the mean, and the root mean square distance from it.

    A cell with over 4 / ``most`` of the points is quartered, so at each of ``DEPTH`` levels at most ``most`` / 4 cells
    are. Points with a null or non-finite coordinate have no bubble.
    """
    own = points.withColumn("_ok", F.expr("coalesce(x between -1e300 and 1e300 and y between -1e300 and 1e300, false)"))
    low_x, high_x, low_y, high_y, n = own.filter("_ok").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    limit = max(1, 4 * (n or 0) // most)
    side = max((high_x or 0) - (low_x or 0), (high_y or 0) - (low_y or 0), 1e-300) * (1 + 1e-9)
    place = [F.when(F.col("_ok"), F.floor((F.col(c) - F.lit(float(low or 0))) / side * (1 << DEPTH)).cast("int")).alias(f"_{c}") for c, low in (("x", low_x), ("y", low_y))]
    own = own.withColumns(dict(zip(("_cx", "_cy"), place, strict=True)))
    fine = written(own.filter("_ok").groupBy("_cx", "_cy").agg(F.count("*").alias("n")))
    each = fine.select("_cx", "_cy", "n", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))).alias("_level"))
    up = [F.expr(f"shiftright({c}, {DEPTH} - _level)").alias(f"_u{c}") for c in ("_cx", "_cy")]
    each = each.select("_cx", "_cy", "n", "_level", *up)
    many = each.groupBy("_level", "_u_cx", "_u_cy").agg(F.sum("n").alias("_s")).filter(F.col("_s") > limit).drop("_s")
    # as many as DEPTH * most / 4 cells are quartered
    deep = each.join(F.broadcast(many), ["_level", "_u_cx", "_u_cy"]).groupBy("_cx", "_cy").agg((F.max("_level") + 1).alias("_level"))
    level = F.coalesce("_level", F.lit(0))
    name = F.concat_ws("/", level, F.expr(f"shiftright(_cx, {DEPTH} - coalesce(_level, 0))"), F.expr(f"shiftright(_cy, {DEPTH} - coalesce(_level, 0))"))
    cells = written(fine.select("_cx", "_cy").join(deep, ["_cx", "_cy"], "left").select("_cx", "_cy", name.alias("bubble")))
    placed = written(own.join(cells, ["_cx", "_cy"], "left").drop("_cx", "_cy", "_ok"))
    spread = F.sqrt(F.var_pop("x") + F.var_pop("y"))
    return placed, placed.filter("bubble is not null").groupBy("bubble").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), spread.alias("spread"))


def cores(at: np.ndarray, n: np.ndarray, spread: np.ndarray, samples: int) -> np.ndarray:
    """The distance within which each bubble has ``samples`` points, itself included; inside a bubble of many, the share of its spread that holds them."""
    out = np.zeros(len(n))
    few = min(samples, len(n))
    for i in range(len(n)):
        if n[i] >= samples:
            out[i] = spread[i] * np.sqrt(samples / n[i])
            continue
        d = np.sqrt(((at - at[i]) ** 2).sum(1))
        near = np.argpartition(d, few - 1)[:few]
        near = near[np.argsort(d[near], kind="stable")]
        held = np.searchsorted(np.cumsum(n[near]), samples)
        out[i] = d[near[min(held, few - 1)]]
    return out


def spanning_tree(at: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (mutual reachability, a, b) of a minimal spanning tree, by rising weight."""
    n = len(at)
    best, link, inside = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    out, now = [], 0
    for _ in range(n - 1):
        inside[now] = True
        reach = np.maximum(np.maximum(core, core[now]), np.sqrt(((at - at[now]) ** 2).sum(1)))
        closer = (reach < best) & ~inside
        best[closer], link[closer] = reach[closer], now
        now = int(np.where(inside, np.inf, best).argmin())
        out.append((float(best[now]), int(link[now]), now))
    return sorted(out)


def _branches(tree: list[tuple[float, int, int]], n: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """The dendrogram: for each join its two parts and its distance (parts from ``len(n)`` on are joins), and the points of every part."""
    root, size, joins = list(range(len(n))), n.tolist(), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, a, b in tree:
        x, y = top(a), top(b)
        new = len(root)
        root.append(new)
        root[x] = root[y] = new
        size.append(size[x] + size[y])
        joins.append((x, y, d))
    return joins, np.array(size)


def stable_clusters(at: np.ndarray, n: np.ndarray, spread: np.ndarray, least: int, samples: int) -> np.ndarray:
    """The cluster of each bubble, largest first, -1 for noise: the branches of ``least`` points or more with the most excess of mass.

    A branch begins where both parts of a join have ``least`` points; other parts are points that fall off it. Its mass
    is the sum, over its points, of 1 / distance at which they leave it less that at which it began. A branch is taken
    whole if its mass exceeds that of the branches within it; the root isn't.
    """
    m = len(n)
    if m < 2:
        return np.full(m, NOISE if m == 0 or n[0] < least else 0)
    core = cores(at, n, spread, samples)
    joins, size = _branches(spanning_tree(at, core), n)
    floor = 1e-12 * max(float(np.ptp(at, axis=0).max()), 1e-300)
    dense = lambda d: 1 / max(d, floor)
    above, born, mass, within = [-1], [0.0], [0.0], [[]]  # of each branch, the root first
    of, fallen = np.zeros(len(size), np.int64), np.zeros(len(size), bool)  # of each part: its branch, and whether its points have left it
    for part in range(len(size) - 1, -1, -1):
        own = int(of[part])
        if part < m:
            if not fallen[part]:  # a bubble of ``least`` points: they part at its own core distance
                mass[own] += n[part] * max(0.0, dense(core[part]) - born[own])
            continue
        a, b, d = joins[part - m]
        splits = size[a] >= least and size[b] >= least and not fallen[part]
        for x in (a, b):
            of[x], fallen[x] = own, fallen[part]
            if fallen[part]:
                continue
            if splits or size[x] < least:
                mass[own] += size[x] * max(0.0, dense(d) - born[own])
            if splits:
                of[x] = len(above)
                within[own].append(len(above))
                above.append(own), born.append(dense(d)), mass.append(0.0), within.append([])
            else:
                fallen[x] = size[x] < least
    best, whole = list(mass), [True] * len(above)
    for k in range(len(above) - 1, -1, -1):
        below = sum(best[c] for c in within[k])
        if k == 0 or (within[k] and below > mass[k]):
            best[k], whole[k] = below, False
    taken = [0] * len(above)
    for k in range(1, len(above)):  # what a branch belongs to comes before it
        taken[k] = taken[above[k]] or (k if whole[k] else 0)
    label = np.array([taken[k] for k in of[:m]])
    order = sorted({k for k in label.tolist() if k}, key=lambda k: (-int(n[label == k].sum()), int(np.flatnonzero(label == k)[0])))
    number = {k: no for no, k in enumerate(order)}
    return np.array([number.get(k, NOISE) for k in label.tolist()])


def _labelled(least: int, samples: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat([*batches, pd.DataFrame({"bubble": [], "n": [], "x": [], "y": [], "spread": []})]).sort_values(["x", "y", "bubble"], ignore_index=True)
        if len(b):
            got = stable_clusters(b[["x", "y"]].to_numpy(float), b["n"].to_numpy(np.int64), b["spread"].to_numpy(float), least, samples)
            yield pd.DataFrame({"bubble": b["bubble"].astype(str), "cluster_id": got.astype(np.int32)})
    return run


def density_clusters(points: DataFrame, min_cluster_size: int = 10, min_samples: int = 5, most: int = BUBBLES) -> DataFrame:
    """``points`` (x, y, ...) with cluster_id: clusters of different densities, from 0 by falling size; -1 is noise.

    A cluster has ``min_cluster_size`` points or more; ``min_samples`` neighbours make a place dense. Of up to
    ``most`` / 4 points each is a bubble of its own (equal ones share one). One group alone, within which nothing
    separates, is noise but for its denser branches. Points without a place are noise; an empty table gives no rows.
    """
    placed, cells = bubbles(points, most)
    # bubbles are bounded: one task
    named = written(cells.coalesce(1).mapInPandas(_labelled(min_cluster_size, min_samples), "bubble string, cluster_id int"))
    return placed.join(F.broadcast(named), "bubble", "left").drop("bubble").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(NOISE)))
