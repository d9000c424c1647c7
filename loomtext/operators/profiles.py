"""Language by function words: the language whose stop words a text uses most."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish", "nl": "dutch", "it": "italian", "pt": "portuguese", "da": "danish", "sv": "swedish"}


def function_word_language(docs: DataFrame, key: str, text: str, prefix: int | None = None) -> DataFrame:
    """(key, lang): ``unknown`` for texts of under 20 characters or without a function word; ties by code.

    A model library is replaced by word profiles, so results are not the reference's. ``prefix`` judges that many
    characters only, as the reference does; by default the whole text counts.
    """
    spark = docs.sparkSession
    rows = [(w, code) for code, name in LANGUAGES.items() for w in StopWordsRemover.loadDefaultStopWords(name)]
    profile = F.broadcast(spark.createDataFrame(rows, "word string, lang string"))
    whole = T.text_or_empty(F.col(text))
    part = F.substring(whole, 1, prefix) if prefix else whole
    found = docs.filter(F.length(whole) >= 20).select(key, F.explode(F.split(T.ngram_form(part), " ")).alias("word"))
    votes = found.groupBy(key, "word").agg(F.count("*").alias("n")).join(profile, "word").groupBy(key, "lang").agg(F.sum("n").alias("n"))
    best = votes.groupBy(key).agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"))
    return docs.select(key).join(best, key, "left").withColumn("lang", F.coalesce("lang", F.lit("unknown")))
