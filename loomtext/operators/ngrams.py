"""N-gram statistics of a corpus: counts, (normalised) pointwise mutual information, effect size, G-test, filters.

Counting adds up within tasks, so the one shuffle, by n-gram, carries a row for each task and n-gram at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from .store import bounded_batches, written

#: The 95 % point of chi-square with one degree of freedom.
SIGNIFICANT_G = 3.841458820694124


def document_ngrams(docs: DataFrame, key: str, text: str, n_min: int = 1, n_max: int = 3) -> DataFrame:
    """(key, ngram, ngram_length, tf): n-gram counts of each document."""
    tokens = docs.select(key, T.words(T.ngram_form(F.col(text))).alias("t"))

    def of_length(n: int) -> Column:
        return F.transform(T.ngrams(F.col("t"), n), lambda g: F.struct(g.alias("ngram"), F.lit(n).alias("ngram_length")))

    per = F.concat(*[of_length(n) for n in range(n_min, n_max + 1)])
    return tokens.select(key, F.explode(per).alias("g")).groupBy(key, "g.ngram", "g.ngram_length").agg(F.count("*").alias("tf"))


def corpus_ngrams(docs: DataFrame, key: str, text: str, n_min: int = 1, n_max: int = 3, min_frequency: int = 1) -> DataFrame:
    """(ngram, ngram_length, frequency, document_frequency, total): total counts all n-grams of the length, rare ones too.

    A document gives each occurrence once for the frequency and each distinct n-gram once for the document frequency,
    so one shuffle, by n-gram, carries sums that tasks have added up; nothing is shuffled by document.
    """
    tokens = docs.select(T.words(T.ngram_form(F.col(text))).alias("t"))

    # columns of their own, so that both uses read n-grams that are built once
    built = tokens.select("t", *[T.ngrams(F.col("t"), n).alias(f"g{n}") for n in range(n_min, n_max + 1)])

    def of_length(n: int) -> list[Column]:
        every = F.col(f"g{n}")
        return [
            F.transform(grams, lambda g: F.struct(g.alias("ngram"), F.lit(n).alias("ngram_length"), F.lit(f).cast("long").alias("f"), F.lit(1 - f).cast("long").alias("d")))
            for grams, f in ((every, 1), (F.array_distinct(every), 0))
        ]

    rows = built.select(F.explode(F.concat(*[c for n in range(n_min, n_max + 1) for c in of_length(n)])).alias("g"))
    sums = rows.groupBy("g.ngram", "g.ngram_length").agg(F.sum("g.f").alias("frequency"), F.sum("g.d").alias("document_frequency"))
    sizes = tokens.agg(*[F.sum(F.greatest(F.lit(0), F.size("t") - (n - 1)).cast("long")).alias(f"n{n}") for n in range(n_min, n_max + 1)])
    totals = sizes.select(F.inline(F.array(*[F.struct(F.lit(n).alias("ngram_length"), F.col(f"n{n}").alias("total")) for n in range(n_min, n_max + 1)])))
    return sums.filter(F.col("frequency") >= min_frequency).join(F.broadcast(totals), "ngram_length").select("ngram", "ngram_length", "frequency", "document_frequency", "total")


def unigram_counts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(T.words(T.ngram_form(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("frequency"))


#: Bytes of text that one vectorised step works on at a time; a longer document makes a step of its own.
STEP_BYTES = 1 << 20
#: Bits of a map of hashes, at most.
MAP_BITS = 27


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """The words of some texts in n-gram form, one text after the other: bytes, where words begin and end, their texts."""

    def __init__(self, texts: pa.Array):
        flat = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
        # a blank between texts, so that no word reaches into the next one
        self.raw = np.full(offsets[-1] + len(flat) + 1, 32, np.uint8)
        at = np.arange(offsets[-1]) + np.repeat(np.arange(len(flat)), np.diff(offsets)) + 1
        self.raw[at] = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        held = np.concatenate((self.raw != 32, [False]))
        self.begin, self.end = np.flatnonzero(held[1:] & ~held[:-1]) + 1, np.flatnonzero(~held[1:] & held[:-1]) + 1
        self.text = np.searchsorted(offsets[:-1] + np.arange(len(flat)) + 1, self.begin, side="right") - 1

    def hashes(self, n_max: int, maps: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 1 to n_max: the n-grams' hashes by first word, and which n-grams are one whose parts, and themselves, are in ``maps``."""
        size = self.end - self.begin
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        power = np.cumprod(np.full(size.max(initial=0) + 1, 0x9E3779B97F4A7C15, np.uint64))
        each = (self.raw[self.raw != 32].astype(np.uint64) + np.uint64(1)) * power[place]
        word = _mixed(np.add.reduceat(each, np.cumsum(size) - size)) if len(size) else np.zeros(0, np.uint64)
        now, live, out = word, np.ones(len(word), bool), []
        for n in range(1, n_max + 1):
            if n > 1:
                now = _mixed(now[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[n - 1 :])
                live = live[:-1] & live[1:] & (self.text[: len(now)] == self.text[n - 1 :]) if len(now) else np.zeros(0, bool)
            if n <= len(maps):
                bit = now & np.uint64(len(maps[n - 1]) * 64 - 1)
                live = live & ((maps[n - 1][bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
            out.append((now, live))
        return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for b in batches:
        sizes, lo = pc.fill_null(pc.binary_length(b["form"]), 0).to_numpy(zero_copy_only=False), 0
        while lo < len(b):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), STEP_BYTES, side="right")))
            yield _Words(b["form"].slice(lo, n))
            lo += n


def _hashed(n: int, maps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _steps(batches):
            every, live = words.hashes(n, maps.value)[-1]
            # half of the hash is shuffled: the maps read less of it
            h, f = np.unique(every[live].astype(np.uint32), return_counts=True)
            yield pa.record_batch({"h": pa.array(h.astype(np.int64)), "f": pa.array(f, pa.int64())})
    return run


def _counted(n_max: int, maps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _steps(batches):
            words_of = np.bincount(words.text) if len(words.text) else np.zeros(0, np.int64)
            for n, (_, live) in enumerate(words.hashes(n_max, maps.value), 1):
                first = np.flatnonzero(live)
                begin, size = words.begin[first], words.end[first + n - 1] - words.begin[first]
                ends = np.cumsum(size)
                at = np.arange(size.sum()) + np.repeat(begin - (ends - size), size)
                grams = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(words.raw[at])).dictionary_encode()
                code, texts = grams.indices.to_numpy().astype(np.int64), max(1, len(words_of))
                f = np.bincount(code, minlength=len(grams.dictionary))
                d = np.bincount(np.unique(code * texts + words.text[first]) // texts, minlength=len(f))
                total = int(np.maximum(0, words_of - (n - 1)).sum())
                every = pa.concat_arrays([grams.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
                yield pa.record_batch({"ngram": every, "ngram_length": pa.array(np.full(len(every), n), pa.int32()), "f": pa.array(np.append(f, total), pa.int64()), "d": pa.array(np.append(d, 0), pa.int64())})
    return run


def _map(hashes: DataFrame) -> np.ndarray:
    """The map of written hashes ``h``: 16 bits or more for each, 2 ** MAP_BITS at most; what it holds beyond them only costs counting."""
    bits = min(MAP_BITS, max(10, (16 * hashes.count()).bit_length()))
    slot = F.shiftrightunsigned(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), 6)
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    rows = hashes.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()  # as rows of Python they would take the driver many times their bytes
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def frequent_ngrams(docs: DataFrame, text: str, n_max: int, min_frequency: int) -> DataFrame:
    """(ngram, ngram_length, frequency, document_frequency) of the n-grams of 1 to n_max words with ``min_frequency``, written.

    A row with a null ngram has as its frequency the number of all n-grams of its length, rare ones too. An n-gram is no
    more frequent than its parts. So, length by length from 2, n-grams whose parts are frequent are counted by their hash,
    and maps of the frequent hashes are sent to the tasks; only n-grams that the maps hold are counted as strings, exactly.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    form = docs.select(T.ngram_form(F.col(text)).alias("form"))
    maps: list[np.ndarray] = []
    if min_frequency > 1 and n_max > 1:
        form = written(form, "zstd")  # read for each length
        maps.append(np.full(16, np.iinfo(np.uint64).max, np.uint64))  # few n-grams are spared by their words alone
    for n in range(2, n_max + 1 if maps else 1):
        hashed = form.mapInArrow(_hashed(n, spark.sparkContext.broadcast(maps[:])), "h long, f long")
        maps.append(_map(written(hashed.groupBy("h").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_frequency).select("h"))))
    rows = form.mapInArrow(_counted(n_max, spark.sparkContext.broadcast(maps)), "ngram string, ngram_length int, f long, d long")
    sums = rows.groupBy("ngram", "ngram_length").agg(F.sum("f").alias("frequency"), F.sum("d").alias("document_frequency"))
    return written(sums.filter(F.col("ngram").isNull() | (F.col("frequency") >= min_frequency)))


def pmi(f: Column, total: Column, log_words: Column, zero: Column) -> Column:
    """log2 of the n-gram's share over the product of its words' shares (``log_words``: the log2 of that product); null where any is zero."""
    return F.when(~zero & (f > 0) & (total > 0), F.log2(f / total) - log_words)


def npmi(f: Column, total: Column, mi: Column) -> Column:
    """PMI over -log2 of the n-gram's share; null if that share is 1."""
    share = f / total
    return F.when((share > 0) & (share < 1), mi / -F.log2(share))


def mutual_information(docs: DataFrame, key: str, text: str, n_min: int = 2, n_max: int = 3, min_frequency: int = 5, smoothing: float = 0.0) -> DataFrame:
    """The n-gram table with mi and npmi; ``smoothing`` is added to every count and total."""
    counted = frequent_ngrams(docs, text, n_max, min_frequency)
    totals = counted.filter("ngram is null").select("ngram_length", F.col("frequency").alias("total"))
    known = counted.filter("ngram is not null")
    grams = known.filter(F.col("ngram_length") >= n_min).join(F.broadcast(totals), "ngram_length").select("ngram", "ngram_length", "frequency", "document_frequency", "total")
    # the words of an n-gram that is kept are as frequent as it is, so they are kept too
    unigrams = known.filter("ngram_length = 1").select(F.col("ngram").alias("word"), "frequency")
    words = totals.filter("ngram_length = 1").select(F.col("total").alias("n_words"))
    k = F.lit(smoothing)
    split = grams.select("ngram", F.explode(F.split("ngram", " ")).alias("word"))
    parts = split.join(unigrams, "word", "left").crossJoin(F.broadcast(words))
    share = (F.coalesce("frequency", F.lit(0)) + k) / (F.col("n_words") + k)
    per = parts.groupBy("ngram").agg(F.sum(F.when(share > 0, F.log2(share))).alias("log_words"), F.max(share <= 0).alias("zero"))
    f, total = F.col("frequency") + k, F.col("total") + k
    out = grams.join(per, "ngram").withColumn("mi", pmi(f, total, F.col("log_words"), F.col("zero")))
    return out.withColumn("npmi", npmi(f, total, F.col("mi"))).drop("log_words", "zero")


def zscore(c: Column, window) -> Column:
    """Standard scores by population deviation: unchanged with fewer than two values, nought if all are equal, null stays."""
    n, mean, sd = F.count(c).over(window), F.avg(c).over(window), F.stddev_pop(c).over(window)
    return F.when(n < 2, c).when(c.isNull(), F.lit(None)).when(sd == 0, F.lit(0.0)).otherwise((c - mean) / sd)


def standardised_by_length(grams: DataFrame) -> DataFrame:
    """mi_z: the standard score of mi among n-grams of the same length, by grouped moments (there are only a few lengths)."""
    moments = grams.groupBy("ngram_length").agg(F.count("mi").alias("_n"), F.avg("mi").alias("_m"), F.stddev_pop("mi").alias("_s"))
    z = F.when(F.col("_n") < 2, F.col("mi")).when(F.col("mi").isNull(), F.lit(None)).when(F.col("_s") == 0, F.lit(0.0)).otherwise((F.col("mi") - F.col("_m")) / F.col("_s"))
    return grams.join(F.broadcast(moments), "ngram_length").withColumn("mi_z", z).drop("_n", "_m", "_s")


def effect_size(f1: Column, n1: Column, f2: Column, n2: Column, k: float = 0.5) -> Column:
    """log2 of the ratio of smoothed rates; nought if a corpus is empty."""
    return F.when((n1 <= 0) | (n2 <= 0), F.lit(0.0)).otherwise(F.log2(((f1 + k) / (n1 + 2 * k)) / ((f2 + k) / (n2 + 2 * k))))


def g_statistic(f1: Column, n1: Column, f2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio, at least nought; nought where a proportion is zero."""
    p1, p2, p = f1 / n1, f2 / n2, (f1 + f2) / (n1 + n2)
    ln = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    part = lambda f, n, q: f * (ln(q) - ln(p)) + (n - f) * (ln(1 - q) - ln(1 - p))
    g = F.greatest(F.lit(0.0), 2 * (part(f1, n1, p1) + part(f2, n2, p2)))
    return F.when((n1 <= 0) | (n2 <= 0) | (f1 <= 0) | (f2 <= 0), F.lit(0.0)).otherwise(g)


@F.pandas_udf(DoubleType())
def p_value(g: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom; Spark has no erfc."""
    return g.map(lambda x: math.erfc(math.sqrt(x / 2)), na_action="ignore")


def compare(target: DataFrame, reference: DataFrame, with_p: bool = True) -> DataFrame:
    """Target n-grams (ngram, frequency, total) against a reference corpus's: freq_reference, effect_size, g_stat, p_value, significant."""
    n2 = F.broadcast(reference.agg(F.max("total").alias("n2")))
    other = reference.select("ngram", F.col("frequency").alias("freq_reference"))
    met = target.join(other, "ngram", "left").crossJoin(n2).withColumn("freq_reference", F.coalesce("freq_reference", F.lit(0)))
    args = F.col("frequency"), F.col("total"), F.col("freq_reference"), F.coalesce("n2", F.lit(0))
    out = met.withColumn("effect_size", effect_size(*args)).withColumn("g_stat", g_statistic(*args)).withColumn("significant", F.col("g_stat") > SIGNIFICANT_G)
    return (out.withColumn("p_value", p_value("g_stat")) if with_p else out).drop("n2")


def filter_by_words(grams: DataFrame, allowed: list[str] | None = None, forbidden: list[str] | None = None) -> DataFrame:
    """N-grams whose words are all allowed and none forbidden; an empty list asks for nothing."""
    words = F.split("ngram", " ")
    if allowed:
        grams = grams.filter(F.size(F.array_except(words, F.array(*map(F.lit, allowed)))) == 0)
    if forbidden:
        grams = grams.filter(~F.arrays_overlap(words, F.array(*map(F.lit, forbidden))))
    return grams


def meaningful(grams: DataFrame, min_mi_z: float = 0.0, min_effect_size: float = 0.0, require_significant: bool = True, min_frequency: int = 3, min_document_frequency: int = 2) -> DataFrame:
    """Phrases of two words or more that pass all thresholds; an unknown score passes."""
    true = F.lit(True)
    keep = (F.col("ngram_length") >= 2) & (F.col("frequency") >= min_frequency) & (F.col("document_frequency") >= min_document_frequency)
    if "mi_z" in grams.columns:
        keep &= F.coalesce(F.col("mi_z") >= min_mi_z, true)
    if "effect_size" in grams.columns:
        keep &= F.coalesce(F.col("effect_size") >= min_effect_size, true)
    if require_significant and "significant" in grams.columns:
        keep &= F.coalesce("significant", true)
    return grams.filter(keep)


def whitelist(phrases: DataFrame, scores: DataFrame, npmi_range: tuple[float, float], effect_range: tuple[float, float]) -> DataFrame:
    """Phrases (ngram) with scores in both ranges, a missing score counting as nought; all phrases if none is left."""
    met = phrases.join(scores, "ngram")
    kept = met.filter(F.coalesce("npmi", F.lit(0.0)).between(*npmi_range) & F.coalesce("effect_size", F.lit(0.0)).between(*effect_range)).select("ngram")
    some = F.broadcast(kept.limit(1).select(F.lit(1).alias("_some")))
    rest = phrases.select("ngram").join(some, how="left", on=F.lit(True)).filter("_some is null").select("ngram")
    return kept.union(rest)


def window_zscore(grams: DataFrame, value: str, group: str) -> DataFrame:
    """The standard score of ``value`` within ``group``, by grouped moments: groups may be few and large. Null groups have none."""
    moments = grams.groupBy(group).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    c = F.col(value)
    z = F.when(F.col("_n") < 2, c).when(c.isNull(), F.lit(None)).when(F.col("_s") == 0, F.lit(0.0)).otherwise((c - F.col("_m")) / F.col("_s"))
    return grams.join(moments, group, "left").withColumn(f"{value}_z", z).drop("_n", "_m", "_s")
