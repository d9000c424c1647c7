"""Queries of vectors and clusters. The embeddings' label stands for a job or a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import density as D
from ..operators import layout as L
from ..operators import outlines as O
from ..operators import tfidf as W
from .registry import query
from .tables import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("embedding is not null")


def _points(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return K.projected(v, "embedding", K.basis(v, "embedding")).drop("embedding")


#: A plane that SQL has as well: the first two components; label 0 stands for noise.
PLANE_SQL = "p AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _plane(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("g11_mean_vectors", "WITH e AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(generate_series(1, 64)) AS t(i) GROUP BY ALL) SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS v FROM e")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return K.mean_vectors(_vectors(spark, d), "label", "embedding").select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("g12_binary_features", "SELECT d.doc_id, v.lang AS value, CAST(CASE WHEN d.lang = v.lang THEN 1 ELSE 0 END AS INTEGER) AS has FROM documents d, (SELECT DISTINCT lang FROM documents) v WHERE d.lang IS NOT NULL")
def g12(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "documents").filter("lang is not null").select("doc_id", F.col("lang").alias("value"))
    names = values.select("value").distinct().agg(F.sort_array(F.collect_list("value")).alias("names"))
    out = K.aspect_features(values, "doc_id", values.count())
    return out.crossJoin(F.broadcast(names)).select("doc_id", F.posexplode("embedding").alias("i", "has"), "names").select("doc_id", F.col("names")[F.col("i")].alias("value"), F.col("has").cast("int").alias("has"))


@query("g17_cluster_rollup", f"WITH {PLANE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS n FROM p WHERE cluster_id <> -1) SELECT cluster_id, count(*) AS size, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) FILTER (n <= 5) AS titles, 'Cluster ' || cluster_id AS label FROM n GROUP BY cluster_id")
def g17_k_rollup(spark: SparkSession, d: str) -> DataFrame:
    return K.rollup(_plane(spark, d), "vec_id", "vec_id").withColumn("titles", F.array_join("titles", ","))


@query("g18_cluster_counts", f"WITH {PLANE_SQL} SELECT count(*) FILTER (cluster_id = -1) AS n_noise, count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters FROM p")
def g18(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cluster_id")
    return _plane(spark, d).agg(F.count_if(c == -1).alias("n_noise"), F.count_distinct(F.when(c != -1, c)).alias("n_clusters"))


@query("j8_labelled_points", f"WITH {PLANE_SQL} SELECT vec_id, CASE WHEN cluster_id = -1 THEN 'Noise' WHEN cluster_id % 2 = 0 THEN 'even ' || cluster_id ELSE 'Cluster ' || cluster_id END AS label FROM p")
def j8(spark: SparkSession, d: str) -> DataFrame:
    named = _plane(spark, d).filter("cluster_id > 0 and cluster_id % 2 = 0").select("cluster_id").distinct().select("cluster_id", F.concat(F.lit("even "), "cluster_id").alias("label"), F.array(F.lit("k")).alias("keywords"))
    return K.with_labels(_plane(spark, d), named).select("vec_id", "label")


@query("r17_cluster_samples", f"WITH {PLANE_SQL} SELECT cluster_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS n FROM p WHERE cluster_id <> -1) WHERE n <= 5")
def r17(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy("vec_id"))
    return _plane(spark, d).filter("cluster_id <> -1").withColumn("n", n).filter("n <= 5").select("cluster_id", "vec_id")


@query("k1_projection", None)
def k1_k2(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("k3_grid_density", None)
def k3(spark: SparkSession, d: str) -> DataFrame:
    return K.grid_density(_points(spark, d)).select("vec_id", "cluster_id")


@query("k3_density_clusters", None)
def k3_density(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of different densities in the projected vectors."""
    return D.density_clusters(_points(spark, d), 10, 5).select("vec_id", "cluster_id")


@query("k4_auto_kmeans", None)
def k4(spark: SparkSession, d: str) -> DataFrame:
    return K.auto_kmeans(_points(spark, d), ["x", "y"], 50).select("vec_id", "cluster_id")


@query("k5_aspect_clusters", None)
def k5_k11(spark: SparkSession, d: str) -> DataFrame:
    """Documents clustered by which frequent words they use, with labels by class-based TF-IDF."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    terms = W.term_counts(docs, "doc_id", "text", 1)
    top = terms.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(30).select("term")
    values = terms.join(F.broadcast(top), "term").select("doc_id", F.col("term").alias("value"))
    features = K.aspect_features(values, "doc_id", docs.count())
    points = K.grid_density(K.projected(features, "embedding", K.basis(features, "embedding")), min_cluster_size=20).select("doc_id", "x", "y", "cluster_id")
    named = W.class_tfidf(points.join(docs, "doc_id"), "cluster_id", "text", 10).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    named = named.withColumn("label", F.array_join(F.slice("keywords", 1, 3), ", "))
    return K.with_labels(points, named).select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster_id", "label")


CONCEPT_SQL = "WITH c AS (SELECT embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id = 0), w AS (SELECT vec_id, exp(3 * list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS w FROM embeddings, c)"


@query("k6_concept_weights", f"{CONCEPT_SQL} SELECT vec_id, round(w / sum(w) OVER (), 9) AS weight FROM w")
def k6(spark: SparkSession, d: str) -> DataFrame:
    concept = [float(x) for x in _vectors(spark, d).filter("vec_id = 0").first()["embedding"]]
    return K.concept_weights(_vectors(spark, d), "embedding", concept).select("vec_id", F.round("weight", 9).alias("weight"))


@query("k6_concept_clusters", None)
def k6_clusters(spark: SparkSession, d: str) -> DataFrame:
    concept = [float(x) for x in _vectors(spark, d).filter("vec_id = 0").first()["embedding"]]
    return K.concept_clusters(_vectors(spark, d), "embedding", concept, 50).select("vec_id", "cluster_id")


@query("k8_label_positions", f"WITH {PLANE_SQL} SELECT cluster_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*)::DOUBLE AS priority FROM p WHERE cluster_id <> -1 GROUP BY cluster_id")
def k8(spark: SparkSession, d: str) -> DataFrame:
    return K.label_positions(_plane(spark, d)).select("cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "priority")


@query("k8_sub_clusters", None)
def k8_sub(spark: SparkSession, d: str) -> DataFrame:
    return K.sub_clusters(_plane(spark, d)).select("vec_id", "cluster_id", "sub_id")


_LAYOUT = f"""WITH RECURSIVE {PLANE_SQL}, span AS (SELECT max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM p),
l AS (SELECT vec_id, CAST(abs(cluster_id) % 2 AS INTEGER) AS level, 'vector ' || vec_id AS text, x, y, CAST(vec_id % 7 AS DOUBLE) AS priority FROM p),
b AS (SELECT level, vec_id, x - 0.5 * 0.011 * sx * len(text) AS x0, x + 0.5 * 0.011 * sx * len(text) AS x1, y - 0.5 * 0.025 * sy AS y0, y + 0.5 * 0.025 * sy AS y1, 0.004 * greatest(sx, sy) AS room,
       row_number() OVER (PARTITION BY level ORDER BY priority DESC, text, x, y) AS n FROM l, span),
walk AS (
  SELECT level, 0 AS n, []::STRUCT(vec_id BIGINT, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE)[] AS kept FROM (SELECT DISTINCT level FROM b)
  UNION ALL
  SELECT w.level, w.n + 1, CASE WHEN len(list_filter(kept, lambda k: NOT (b.x1 + room < k.x0 OR k.x1 + room < b.x0 OR b.y1 + room < k.y0 OR k.y1 + room < b.y0))) > 0 THEN kept
         ELSE list_append(kept, {{'vec_id': b.vec_id, 'x0': b.x0, 'x1': b.x1, 'y0': b.y0, 'y1': b.y1}}) END
  FROM walk w JOIN b ON w.level = b.level AND b.n = w.n + 1
), done AS (SELECT level, unnest(kept).vec_id AS vec_id FROM (SELECT level, arg_max(kept, n) AS kept FROM walk GROUP BY level))
SELECT vec_id, level, text FROM done JOIN l USING (vec_id, level)"""


@query("k8_label_layout", _LAYOUT)
def k8_layout(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as labels of two levels, those that can be shown."""
    p = _plane(spark, d)
    span = p.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    labels = p.select("vec_id", F.pmod(F.abs("cluster_id"), F.lit(2)).cast("int").alias("level"), F.concat(F.lit("vector "), "vec_id").alias("text"), "x", "y", (F.col("vec_id") % 7).cast("double").alias("priority"))
    return L.without_overlaps(labels, *[float(s or 0.0) for s in span]).select("vec_id", "level", "text")


@query("k8_two_level_labels", None)
def k8_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the vectors' clusters and of their parts, by the documents of the same number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    points = K.sub_clusters(_plane(spark, d)).join(docs, "vec_id")
    names = W.class_tfidf(points, "cluster_id", "text", 3).groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("label"))
    return L.two_level_labels(points, names, "text").withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("k9_outlines", None)
def k9_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Concave outlines of the vectors' clusters."""
    return O.outlines(_plane(spark, d)).select("cluster_id", F.size("path").alias("corners"), F.to_json("path").alias("path"))


@query("k9_hulls", None)
def k9(spark: SparkSession, d: str) -> DataFrame:
    return K.hulls(_plane(spark, d)).select("cluster_id", F.size("path").alias("corners"), F.to_json("path").alias("path"))
