"""A training corpus from documents: language, near copies, benchmark passages, secrets, sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import common, decontaminate, language_id, near_dedup, packing, secret_scan

#: The least posterior probability of a document's language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in one of the learned languages; texts without a letter go."""
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    names = {"lang_pred": "__pred", "score": "__score"}
    judged = language_id.predict(docs.withColumnsRenamed({c: f"__own_{c}" for c in names if c in docs.columns}), model, [f"__own_{c}" if c in names else c for c in docs.columns])
    kept = judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop(*names)
    return kept.withColumnsRenamed({f"__own_{c}": c for c in names}).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (0.8 of the five-word shingles): the smallest doc_id, then text key.

    Documents are told apart by doc_id and text, so an id with two different texts is two documents, of which each stays
    unless it is a copy of another. Of repeated rows one stays. Rows without an id, which nothing is linked with, all stay.
    """
    found = common.written(near_dedup.near_duplicates(docs).filter("doc_id is not null").groupBy("copies", "doc_id", "key").agg(F.count("*").alias("rows")))
    first = found.filter("copies is not null").groupBy("copies").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    # by document, not by group: a document is in one group, and a group may be large
    gone = found.filter("copies is not null").join(first, ["doc_id", "key"], "left_anti").select("doc_id", "key")
    again = found.filter("rows > 1").select("doc_id", "key")
    marks = gone.withColumn("__gone", F.lit(True)).union(again.join(gone, ["doc_id", "key"], "left_anti").withColumn("__gone", F.lit(False)))
    marks = common.written(marks.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__gone"))
    marks = common.sent_if_small(marks)
    same = (docs["doc_id"] == F.col("__id")) & (common.text_key(docs["text"].cast("string")) == F.col("__key"))
    once = docs.join(marks, same, "left_anti").select(docs.columns)
    repeated = docs.join(common.sent_if_small(marks.filter("not __gone")), same).dropDuplicates(["__id", "__key"]).select(docs.columns)
    return once.union(repeated)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = common.written(found.filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct())
    own = common.text_key(docs["text"].cast("string"))
    bad = common.sent_if_small(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (own == bad["__key"]), "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every finding; n_chars follows. No document goes."""
    found = secret_scan.scan(docs).filter(F.size("found") > 0).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "found").withColumnRenamed("found", "__found")
    found = common.written(found.dropDuplicates(["__id", "__key"]))
    own = common.text_key(F.coalesce(docs["text"].cast("string"), F.lit("")))
    met = docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (own == found["__key"]), "left")
    text = F.when(F.col("__found").isNotNull(), secret_scan.redacted(docs["text"], F.col("__found"))).otherwise(docs["text"])
    cols = {"text": text, "n_chars": F.when(F.col("__found").isNotNull(), F.length(text).cast("long")).otherwise(docs["n_chars"])} if "n_chars" in docs.columns else {"text": text}
    return met.select(*[cols[c].alias(c) if c in cols else docs[c] for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language), ("near_dedup", near_copies), ("decontamination", benchmark_passages), ("secret_scan", secrets), ("packing", sequences)]

#: Language ID and tokens are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs)
    return docs
