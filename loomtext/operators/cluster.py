"""Projection, clustering, labels and outlines of clusters.

Where the reference calls single-machine libraries, these are re-aimed at what spreads over a cluster: an (uncentred)
SVD for the projection, k-means with a silhouette choice or a grid-density clustering for the groups. Results are not
the libraries' results. Only things of fixed size reach the driver: the Gram matrix, centroids, sums by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import numbered, written

NOISE = -1
#: How often a cell of the raster may be halved.
LEVELS = 20


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, embedding): the mean of each key's vectors, at unit length (a zero mean stays)."""
    own = rows.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    means = own.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_m"))
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda s, x: s + x * x))
    return means.withColumn("_n", norm).select(key, F.transform("_m", lambda x: x / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).alias("embedding"))


#: Dimensions of aspect features, at most: the driver holds their squared Gram matrix.
FEATURES = 1024


def aspect_features(values: DataFrame, key: str, n_jobs: int, min_coverage: float = 0.05, most: int = FEATURES) -> DataFrame | None:
    """(key, embedding): a binary vector over the distinct values; None with under two values, or too few jobs that have any.

    Up to ``most`` values have a dimension each, in the order of values. Of more, each goes to the dimension that its
    hash names, which several share; a job's vector then has the number of its values there.
    """
    values = written(values.select(key, "value").filter("value is not null").distinct())
    distinct = values.select("value").distinct()
    n, have = distinct.count(), values.select(key).distinct().count()
    if n < 2 or have < max(2, min_coverage * n_jobs):
        return None
    if n <= most:
        placed = values.join(numbered(distinct, ["value"], "_place"), "value").select(key, F.col("_place").cast("int").alias("_at"))
    else:
        placed = values.select(key, F.pmod(F.xxhash64("value"), F.lit(most)).cast("int").alias("_at"))
    counts = placed.groupBy(key, "_at").agg(F.count("*").cast("double").alias("_c")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_c"))).alias("_m"))
    return counts.select(key, F.transform(F.sequence(F.lit(0), F.lit(min(n, most) - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("embedding"))


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for b in batches:
        x = np.array(b["v"].tolist(), float).reshape(len(b), -1)
        total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pd.DataFrame({"i": np.arange(total.size), "g": total.ravel()})


def basis(rows: DataFrame, vector: str, dims: int = 2) -> np.ndarray:
    """(attributes, dims): the leading right singular vectors, largest component positive; noughts where the rank is short."""
    got = rows.select(F.col(vector).alias("v")).filter("v is not null").mapInPandas(_gram, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")
    n = int(round(len(got) ** 0.5))
    value, vec = np.linalg.eigh(got["g"].to_numpy().reshape(n, n)) if n else (np.zeros(0), np.zeros((0, 0)))
    out = np.zeros((n, dims))
    for k in range(min(dims, n)):
        v = vec[:, -1 - k]
        if value[-1 - k] > 1e-12 * max(value.max(), 1e-300):
            out[:, k] = v * np.sign(v[np.abs(v).argmax()])
    return out


def projected(rows: DataFrame, vector: str, base: np.ndarray, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``rows`` with their coordinates on a basis, which other rows may have given."""
    def dot(column: np.ndarray) -> Column:
        return F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(c)) for c in column]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)

    return rows.withColumns({n: dot(base[:, k]) for k, n in enumerate(names)})


def auto_kmeans(rows: DataFrame, features: list[str], min_cluster_size: int = 10, seed: int = 42, most: int = 12) -> DataFrame:
    """``rows`` with cluster_id: k-means of the k with the best (squared Euclidean) silhouette; one cluster with under two rows."""
    rows = written(rows)  # read by every fit
    n = rows.count()
    if n < 2:
        return rows.withColumn("cluster_id", F.lit(0))
    data = rows.withColumn("_f", array_to_vector(F.array(*[F.col(c).cast("double") for c in features])))
    best, score = None, -2.0
    for k in range(2, min(most, max(2, n // min_cluster_size), n - 1 if n > 2 else 2) + 1):
        model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster_id").fit(data)
        found = model.transform(data)
        s = ClusteringEvaluator(featuresCol="_f", predictionCol="cluster_id").evaluate(found) if found.select("cluster_id").distinct().count() > 1 else -1.0
        if s > score:
            best, score = model, s
    return best.transform(data).drop("_f")


def components(edges: DataFrame) -> DataFrame:
    """(node, group): the least node that can be reached over ``edges`` (a, b), for each node of an edge but the least ones.

    Large and small stars by turns, each written, until nothing changes; no group is gathered in one row.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        hops = large.join(own, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = written(hops.union(own).distinct())
        if small.count() == edges.count() and small.subtract(edges).isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("group"))
        edges = small


def grid_density(rows: DataFrame, x: str = "x", y: str = "y", min_cluster_size: int = 10, min_samples: int = 5, share: float = 0.75) -> DataFrame:
    """``rows`` with cluster_id: groups of adjoining dense cells of a raster that the data set, -1 for the rest.

    The cells are the smallest (the 10 to 90 % range, halved up to LEVELS times) of which ``share`` of the rows lie in one
    with ``min_samples`` rows: a bound on that quantile of the rows' neighbour distances, so cells shrink as rows grow
    in number, and far rows don't stretch them. Such cells are dense; rows of other cells go with a dense one next to
    theirs. Groups under ``min_cluster_size`` rows, and rows with a coordinate that is null or not finite, are noise.
    Clusters are numbered from the largest. A row for each level reaches the driver; cells are joined up by tables.
    """
    finite = (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))
    tenths = [F.percentile_approx(c, [0.1, 0.9]).alias(c) for c in (x, y)]
    box = rows.filter(finite).agg(*tenths, *[(F.max(c) - F.min(c)).alias(f"_{c}") for c in (x, y)]).first()
    if box[x] is None:
        return rows.withColumn("cluster_id", F.lit(NOISE))
    wide = max(float(box[c][1] - box[c][0]) for c in (x, y)) or max(float(box[f"_{c}"]) for c in (x, y)) or 1.0
    finest = 2.0 ** (math.ceil(math.log2(wide)) - LEVELS)
    place = lambda c: F.when(finite, F.floor(F.greatest(F.lit(-(2.0**52)), F.least(F.lit(2.0**52), F.col(c) / finest))))
    placed = rows.withColumns({"_i": place(x), "_j": place(y)})
    counts = written(placed.filter("_i is not null").groupBy("_i", "_j").agg(F.count("*").alias("n")))
    each = counts.select(F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("l"), "_i", "_j", "n")
    each = each.groupBy("l", F.expr("shiftright(_i, l)").alias("i"), F.expr("shiftright(_j, l)").alias("j")).agg(F.sum("n").alias("n"))
    levels = each.groupBy("l").agg(F.sum(F.when(F.col("n") >= min_samples, F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("every")).collect()
    level = min((r["l"] for r in levels if r["inside"] >= share * r["every"]), default=LEVELS)

    own = lambda c: F.shiftright(c, level)
    cells = written(counts.groupBy(F.struct(own("_i").alias("i"), own("_j").alias("j")).alias("cell")).agg(F.sum("n").alias("n")))
    dense = cells.filter(F.col("n") >= min_samples).select("cell")
    shifted = lambda steps: F.explode(F.array(*[F.struct((F.col("cell.i") + a).alias("i"), (F.col("cell.j") + b).alias("j")) for a, b in steps]))
    later = dense.select(F.col("cell").alias("b"), shifted([(0, 1), (1, -1), (1, 0), (1, 1)]).alias("cell"))
    joined = components(later.join(dense, "cell").select(F.col("cell").alias("a"), "b")).withColumnRenamed("node", "cell")
    groups = dense.join(joined, "cell", "left").select("cell", F.coalesce("group", "cell").alias("group"))
    around = groups.select("group", shifted([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]).alias("cell"))
    # all dense neighbours of a dense cell are of its group, so the least group is its own
    owned = written(around.groupBy("cell").agg(F.min("group").alias("group")).join(cells, "cell"))
    big = owned.groupBy("group").agg((-F.sum("n")).alias("_less")).filter(F.col("_less") <= -min_cluster_size)
    named = owned.join(numbered(big, ["_less", "group"], "cluster_id"), "group").select(F.col("cell.i").alias("_i"), F.col("cell.j").alias("_j"), F.col("cluster_id").cast("int").alias("cluster_id"))
    met = placed.withColumns({"_i": own("_i"), "_j": own("_j")}).join(named, ["_i", "_j"], "left")
    return met.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(NOISE))).drop("_i", "_j")


def concept_weights(rows: DataFrame, vector: str, concept: list[float], strength: float = 3.0) -> DataFrame:
    """``rows`` with weight: exp(strength * cosine with the concept), summing to 1."""
    norm = sum(c * c for c in concept) ** 0.5 or 1.0
    dot = F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(c) / norm) for c in concept]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    raw = rows.withColumn("_w", F.exp(strength * dot / F.when(size > 0, size).otherwise(1.0)))
    total = F.broadcast(raw.agg(F.sum("_w").alias("_total")))
    return raw.crossJoin(total).withColumn("weight", F.col("_w") / F.col("_total")).drop("_w", "_total")


def concept_clusters(rows: DataFrame, vector: str, concept: list[float], min_cluster_size: int = 10) -> DataFrame:
    """Rows weighted by a concept, projected and clustered."""
    weighted = concept_weights(rows, vector, concept).withColumn("_v", F.transform(vector, lambda x: x.cast("double") * F.col("weight")))
    return auto_kmeans(projected(weighted, "_v", basis(weighted, "_v")), ["x", "y"], min_cluster_size).drop("_v")


def rollup(points: DataFrame, title: str, position: str, named: DataFrame | None = None, titles: int = 5) -> DataFrame:
    """(cluster_id, size, titles, label): clusters but noise, with their first titles."""
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(title).cast("string").alias("t")))), 1, titles), lambda x: x["t"])
    # the collected list holds the first titles only: rows beyond them are left out before it
    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy(position))
    top = points.filter(F.col("cluster_id") != NOISE).withColumn("_n", n)
    sizes = top.groupBy("cluster_id").agg(F.count("*").alias("size"))
    out = sizes.join(top.filter(F.col("_n") <= titles).groupBy("cluster_id").agg(first.alias("titles")), "cluster_id")
    label = F.concat(F.lit("Cluster "), F.col("cluster_id"))
    if named is None:
        return out.withColumn("label", label)
    return out.join(named.select("cluster_id", F.col("label").alias("_l")), "cluster_id", "left").withColumn("label", F.coalesce(F.when(F.col("_l") != "", F.col("_l")), label)).drop("_l")


def with_labels(points: DataFrame, named: DataFrame) -> DataFrame:
    """Points with label and keywords of their cluster; ``Noise`` and none for noise."""
    out = points.join(named.select("cluster_id", "label", "keywords"), "cluster_id", "left")
    label = F.when(F.col("cluster_id") == NOISE, F.lit("Noise")).otherwise(F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id"))))
    return out.withColumn("label", label).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def sub_clusters(points: DataFrame, rounds: int = 8, least: int = 20) -> DataFrame:
    """Points (cluster_id, x, y) with sub_id: large clusters split in 2, 3 (40 points) or 4 (100), others in one part.

    Lloyd's rounds of all clusters at once; the first centroids lie at quantiles of x. Only centroids are joined.
    """
    own = points.filter(F.col("cluster_id") != NOISE)
    size = own.groupBy("cluster_id").agg(F.count("*").alias("_n"), F.percentile_approx("x", [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]).alias("_q"), F.avg("y").alias("_y"))
    k = F.when(F.col("_n") < least, 1).when(F.col("_n") < 40, 2).when(F.col("_n") < 100, 3).otherwise(4)
    at = {1: [3], 2: [1, 5], 3: [0, 3, 6], 4: [0, 2, 4, 6]}
    starts = F.coalesce(*[F.when(k == n, F.array(*[F.lit(i) for i in q])) for n, q in at.items()])
    centres = size.select("cluster_id", "_y", "_q", F.posexplode(starts).alias("sub_id", "_i")).select("cluster_id", "sub_id", F.get(F.col("_q"), F.col("_i")).alias("cx"), F.col("_y").alias("cy"))
    for _ in range(rounds):
        # a handful of centroids a cluster: collected and sent anew, so that plans don't grow with the rounds
        rows = [tuple(r) for r in centres.collect()]
        centres = F.broadcast(points.sparkSession.createDataFrame(rows, "cluster_id int, sub_id int, cx double, cy double"))
        arrays = centres.groupBy("cluster_id").agg(F.collect_list(F.struct("sub_id", "cx", "cy")).alias("_c"))
        dist = F.array_min(F.transform("_c", lambda c: F.struct(((F.col("x") - c["cx"]) ** 2 + (F.col("y") - c["cy"]) ** 2).alias("d"), c["sub_id"].alias("sub_id"))))
        assigned = own.join(F.broadcast(arrays), "cluster_id").withColumn("sub_id", dist["sub_id"]).drop("_c")
        centres = assigned.groupBy("cluster_id", "sub_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return assigned


def label_positions(points: DataFrame, level: int = 0) -> DataFrame:
    """(cluster_id, sub_id, x, y, level, priority): where labels stand, at the mean of the points."""
    keys = ["cluster_id"] if level == 0 else ["cluster_id", "sub_id"]
    out = points.filter(F.col("cluster_id") != NOISE).groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").cast("double").alias("priority"))
    return (out if level else out.withColumn("sub_id", F.lit(None).cast("int"))).withColumn("level", F.lit(level)).select("cluster_id", "sub_id", "x", "y", "level", "priority")


def _chain(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the smallest point."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _task_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for c, g in b.groupby("cluster_id"):
            x = g[["x", "y"]].to_numpy(float)
            held[c] = _chain(np.concatenate((held[c], x)) if c in held else x)
    for c, hull in held.items():
        yield pd.DataFrame({"cluster_id": np.full(len(hull), c), "x": hull[:, 0], "y": hull[:, 1]})


def _hull(g: pd.DataFrame) -> pd.DataFrame:
    hull = _chain(g[["x", "y"]].to_numpy(float))
    return pd.DataFrame({"cluster_id": [g["cluster_id"].iloc[0]], "path": [hull.tolist()]})


def hulls(points: DataFrame, least: int = 4) -> DataFrame:
    """(cluster_id, path): the convex outline of clusters of four points or more; tasks send the corners of their own part."""
    big = points.filter(F.col("cluster_id") != NOISE).groupBy("cluster_id").count().filter(F.col("count") >= least).select("cluster_id")
    corners = points.select(F.col("cluster_id").cast("int"), "x", "y").mapInPandas(_task_hulls, "cluster_id int, x double, y double")
    return corners.join(big, "cluster_id", "left_semi").groupBy("cluster_id").applyInPandas(_hull, "cluster_id int, path array<array<double>>")
