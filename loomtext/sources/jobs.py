"""Reading job stores, vocabularies and the tables that operators write."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a job document, and the names they get.
FIELDS = {
    "title": "title", "companyName": "company", "description": "description", "location": "location", "sector": "sector", "contractType": "contract_type",
    "experienceLevel": "experience_level", "applyType": "apply_type", "workType": "work_type", "salary": "salary", "jobUrl": "url", "applyUrl": "apply_url",
}
_DATA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
_META = T.StructType([T.StructField("days_old", T.IntegerType()), T.StructField("applied_times", T.StringType())])
DOCUMENT = T.StructType([T.StructField("scraped", T.BooleanType()), *_DATA.fields, T.StructField("job_data", _DATA), T.StructField("meta", _META)])
STORE = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("updatedAt", T.StringType()), T.StructField("jobs", T.MapType(T.StringType(), DOCUMENT))])


class StoreError(ValueError):
    """A file that isn't a job store."""


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Jobs (normalised) of one store file ``{"jobs": {id: document}}``: those scraped or with a description.

    One JSON object can't be split; for large corpora write it as JSON lines once and use ``read_lines``.
    """
    raw = spark.read.schema(STORE).json(path, multiLine=True)
    if raw.filter("jobs is null").limit(1).count():
        raise StoreError(f"{path} has no object of jobs")
    return normalised(raw.select(F.posexplode("jobs").alias("job_pos", "store_id", "doc")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of JSON lines, a document each, with its store id; job_pos is by id."""
    schema = T.StructType([T.StructField("store_id", T.StringType()), *DOCUMENT.fields])
    raw = spark.read.schema(schema).json(path)
    return normalised(raw.select(F.xxhash64("store_id").alias("job_pos"), "store_id", F.struct(*[f.name for f in DOCUMENT.fields]).alias("doc")))


def job_key(url: Column, company: Column, title: Column) -> Column:
    """The URL, else company and title; one function for every reader, so that all tables join (the reference has two)."""
    known = lambda c: F.coalesce(F.when(c != "", c), F.lit("unknown"))
    return F.coalesce(F.when(url != "", url), F.concat_ws("|", known(company), known(title)))


def normalised(rows: DataFrame) -> DataFrame:
    """Flat and nested documents in one form, with key, age and times applied; dropped if not scraped and without description."""
    field = lambda f: F.coalesce(F.col(f"doc.job_data.{f}"), F.col(f"doc.{f}"))
    out = rows.select("job_pos", "store_id", F.col("doc.scraped").alias("scraped"), *[field(f).alias(n) for f, n in FIELDS.items()], F.col("doc.meta.days_old").alias("days_old"), F.col("doc.meta.applied_times").alias("applied_times"))
    kept = out.filter(F.coalesce("scraped", F.lit(False)) | (F.length(F.coalesce("description", F.lit(""))) > 0)).drop("scraped")
    return kept.withColumn("job_key", job_key(F.col("url"), F.col("company"), F.col("title")))


def read_vocabulary(spark: SparkSession, path: str, aspect: str) -> DataFrame:
    """(aspect, term): a term a line; blank lines and those that begin with # are left out."""
    term = F.trim("value")
    return spark.read.text(path).select(F.lit(aspect).alias("aspect"), term.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#"))


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, sorted within files by ``by`` so that readers of one key skip row groups."""
    (df.sortWithinPartitions(by) if by else df).write.mode(mode).parquet(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_chunks(spark: SparkSession, path: str, job: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("job_key") == job) if job is not None else df


def aspect_records(aspects: DataFrame, jobs: DataFrame) -> DataFrame:
    """One record a job for export: job_id, title, company, aspects (a map); jobs without aspects too."""
    from ..operators.aspects import as_map

    empty = F.create_map().cast("map<string,array<string>>")
    return jobs.join(as_map(aspects, "job_key"), "job_key", "left").select(F.col("job_key").alias("job_id"), "title", "company", F.coalesce("aspects", empty).alias("aspects"))


def keyword_records(terms: DataFrame, key: str) -> DataFrame:
    """(job_id, keywords) of ranked terms."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return terms.groupBy(F.col(key).alias("job_id")).agg(words.alias("keywords"))


def phrase_scores(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, npmi, effect_size) as ``write_table`` left them."""
    return spark.read.parquet(path).select("ngram", "npmi", "effect_size")


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(ngram): the list of a phrase file ``{"phrases": [...]}``, each once; nulls and empty ones are left out."""
    raw = spark.read.schema("phrases array<string>").option("multiLine", True).json(path)
    return raw.select(F.explode("phrases").alias("ngram")).filter("ngram <> ''").distinct()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, label, pos) of a label file ``{job: [label, ...]}`` or of such lines; jobs without labels have no row.

    Of a label that a job has twice the first place counts; a file that isn't such a map gives no rows.
    """
    kind, mode = "map<string, array<string>>", {"mode": "PERMISSIVE"}
    whole = spark.read.text(path, wholetext=True)
    # a file is one map, which may span lines, or a map a line
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^\s*\{.*\}\s*$"))
    maps = F.transform(F.when(F.size(lines) > 0, lines).otherwise(F.array("value")), lambda x: F.from_json(x, kind, mode))
    each = whole.select(F.explode(maps).alias("m")).filter("m is not null").select(F.explode("m").alias("job_id", "labels"))
    return each.select("job_id", F.posexplode("labels").alias("pos", "label")).filter("label is not null").groupBy("job_id", "label").agg(F.min("pos").alias("pos")).select("job_id", "label", "pos")


def write_labels(labels: DataFrame, path: str, job: str = "job_id", label: str = "label", order: str = "pos", mode: str = "overwrite") -> None:
    """Labels as JSON lines ``{job: [label, ...]}``, a job a line, in their order; ``read_labels`` reads them a file at a time."""
    lists = labels.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, label))), lambda x: x[label]).alias("l"))
    lists.select(F.to_json(F.create_map(F.col(job).cast("string"), "l")).alias("value")).write.mode(mode).text(path)


class ClusterCache:
    """Cluster results as a Parquet table with a partition for each key; outlines and labels beside it.

    The key holds every parameter of a result, so that none is served for other filters (the reference leaves some out).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def key(aspect: str, **parameters) -> str:
        name = aspect.lower().replace("/", "_").replace(" ", "_")
        return f"{name}-{hashlib.sha256(json.dumps([name, parameters], sort_keys=True, default=str).encode()).hexdigest()[:16]}"

    def save(self, key: str, df: DataFrame, layer: str = "points") -> None:
        df.withColumn("cache_key", F.lit(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(f"{self.path}/{layer}")

    def _table(self, layer: str) -> DataFrame | None:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{layer}")
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return None
        return self.spark.read.parquet(f"{self.path}/{layer}")

    def keys(self, layer: str = "points") -> list[str]:
        df = self._table(layer)
        return [] if df is None else sorted(r[0] for r in df.select("cache_key").distinct().collect())

    def has(self, key: str) -> bool:
        return key in self.keys()

    def load(self, key: str, layer: str = "points") -> DataFrame | None:
        df = self._table(layer)
        return None if df is None or key not in self.keys(layer) else df.filter(F.col("cache_key") == key).drop("cache_key")

    def through(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The points under ``key``; made, saved and read again if there are none."""
        found = self.load(key)
        if found is None:
            self.save(key, make())
            found = self.load(key)
        return found

    def invalidate(self, key: str) -> None:
        for layer in ("points", "polygons", "labels"):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{layer}/cache_key={key}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
