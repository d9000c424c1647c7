"""Matching texts with many terms, and names with names, without comparing all pairs.

Terms of a vocabulary are met by an Aho-Corasick automaton in one pass over each text; similar names share bigrams, which
an equi-join counts before any two names are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from .store import written

#: A word with the marks that names of tools hold: c++, c#, .net, node.js, ci/cd.
VOCABULARY_TOKEN = r"\.?[\p{L}\p{N}_](?:[\p{L}\p{N}_+#]|[.\-/&](?=[\p{L}\p{N}_]))*"


#: Characters of vocabulary terms that one automaton holds; a larger vocabulary takes several, each a scan of the texts.
AUTOMATON = 4_000_000
#: Characters of evidence on either side.
EVIDENCE = 30


def _places(text: str, words: list[str], upto: int) -> list[int]:
    """Where the first ``upto`` of a text's words begin in it."""
    out, at = [], 0
    for w in words[:upto]:
        at = text.index(w, at)
        out.append(at)
        at += len(w)
    return out


def _scan(terms, key: StructField, words: bool):
    """(key, term, value, pos, evidence) of the first place of each term in each text, by an Aho-Corasick automaton.

    ``words``: terms are words with a blank between, before and after them, and so are texts (``_hay``); pos is then the
    number of the first word. Else pos counts characters, from 1.
    """
    import ahocorasick

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for no, term in enumerate(terms.value):
            machine.add_word(f" {term} " if words else term, (no, len(term) + 2 * words))
        machine.make_automaton()
        for b in batches:
            row, term, value, pos, evidence = [], [], [], [], []
            for k, (hay, text) in enumerate(zip(b["_hay"].to_pylist(), b["_own"].to_pylist(), strict=True)):
                first: dict[int, int] = {}
                for end, (no, n) in machine.iter(hay or ""):
                    first.setdefault(no, end - n + 1)
                if not first:
                    continue
                text = text if words or len(text) == len(hay) else hay
                begin = dict(first)
                size = {no: len(terms.value[no]) for no in first}
                if words:
                    blanks = np.flatnonzero(np.frombuffer(hay.encode("utf-32-le"), np.uint32) == 32)
                    own = b["_words"][k].as_py()
                    nth = {no: int(np.searchsorted(blanks, at)) for no, at in first.items()}
                    last = {no: at + terms.value[no].count(" ") for no, at in nth.items()}
                    places = _places(text, own, max(last.values()) + 1)
                    begin = {no: places[at] for no, at in nth.items()}
                    size = {no: places[last[no]] + len(own[last[no]]) - begin[no] for no in first}
                    value += [" ".join(own[nth[no] : last[no] + 1]) for no in first]
                    pos += nth.values()
                else:
                    value += [terms.value[no] for no in first]
                    pos += [at + 1 for at in first.values()]
                row += [k] * len(first)
                term += [terms.value[no] for no in first]
                evidence += [text[max(0, begin[no] - EVIDENCE) : begin[no] + size[no] + EVIDENCE].strip() for no in first]
            yield pa.record_batch([b[key.name].take(pa.array(row, pa.int64())), pa.array(term, pa.string()), pa.array(value, pa.string()), pa.array(pos, pa.int32()), pa.array(evidence, pa.string())], [key.name, "term", "value", "pos", "evidence"])
    return run


def term_hits(docs: DataFrame, key: str, text: str, terms: DataFrame, words: bool = False, most: int = AUTOMATON) -> DataFrame:
    """(key, term, value, pos, evidence): the first place of each of ``terms`` (term, lower case) in each lower-cased text.

    ``words``: terms are sequences of vocabulary words with a blank between, met as whole words, value as written in the
    text, pos the number of the first word; else anywhere, pos its first character (from 1). evidence: up to ``EVIDENCE``
    characters on either side (of the lower-cased text, if lower case changes its length). Empty and null terms are none. Terms are dealt into parts of about ``most`` characters, so no
    automaton grows with the vocabulary. Texts are scanned once a part; nothing is joined but what hits.
    """
    spark = docs.sparkSession
    once = written(terms.select("term").filter("term <> ''").distinct())
    size = once.agg(F.sum(F.length("term"))).first()[0] or 0
    parts = -(-size // most)
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if words:
        slim = docs.select(key, source.alias("_own"), F.regexp_extract_all(source, F.lit(VOCABULARY_TOKEN), F.lit(0)).alias("_words"))
        slim = slim.withColumn("_hay", F.concat(F.lit(" "), F.lower(F.array_join("_words", " ")), F.lit(" ")))
    else:
        slim = docs.select(key, F.lower(source).alias("_hay"), source.alias("_own"))
    field = StructField(key, docs.schema[key].dataType)
    kind = StructType([field, StructField("term", StringType()), StructField("value", StringType()), StructField("pos", IntegerType()), StructField("evidence", StringType())])
    out = spark.createDataFrame([], kind)
    for part in range(parts):
        own = [r[0] for r in once.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect()]  # about ``most`` characters
        if own:
            out = out.union(slim.mapInArrow(_scan(spark.sparkContext.broadcast(own), field, words), kind))
    return out


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of strings, bit-parallel over all pairs at once.

    A pair's row of the usual table is a bit vector over the characters of ``a`` (64 to a word), which each character
    of ``b`` turns into the next row by one addition; a bit that is cleared stands for one more common character.
    """
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    wide = -(-max(int(n.max(initial=0)), 1) // 64)
    codes = [np.frombuffer("".join(x.ljust(w, "\0") for x in side).encode("utf-32-le"), np.uint32).reshape(len(side), w) for side, w in ((a, wide * 64), (b, max(int(m.max(initial=0)), 1)))]
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    inside = (np.arange(wide * 64) < n[:, None]).reshape(-1, wide, 64)
    row = np.full((len(a), wide), ~np.uint64(0))
    for j in range(int(m.max(initial=0))):
        same = (codes[0] == codes[1][:, j : j + 1]).reshape(-1, wide, 64) & inside & (j < m)[:, None, None]
        mask = (same * bit).sum(2, dtype=np.uint64)
        carry = np.zeros(len(a), np.uint64)
        for w in range(wide):
            met = row[:, w] & mask[:, w]
            first = row[:, w] + met
            total = first + carry
            carry = ((first < met) | (total < carry)).astype(np.uint64)
            row[:, w] = total | (row[:, w] & ~mask[:, w])
    return (inside & ((row[:, :, None] & bit) == 0)).sum((1, 2)).astype(np.int64)


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """200 * (longest common subsequence) / (both lengths), 100 of two empty strings."""
    both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(both > 0, 200.0 * common_subsequences(a, b) / np.maximum(both, 1), 100.0)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            b = batch.slice(at, 2000)
            form, low = b["_form"].to_pylist(), b["_low"].to_pylist()
            order = sorted(range(len(form)), key=lambda k: len(form[k]))  # long names pad no short ones
            ratio = np.zeros(len(form))
            for lo in range(0, len(order), 500):
                some = order[lo : lo + 500]
                ratio[some] = indel_ratios([form[k] for k in some], [low[k] for k in some])
            yield pa.record_batch([b["_form"], b["_name"], pa.array(ratio)], ["_form", "_name", "_r"])


def _grams(form: Column, short: int) -> Column:
    """Tokens of a string that similar ones share: its bigrams, numbered where they repeat; its characters if it is shorter than ``short``."""
    def numbered(parts: Column) -> Column:
        return F.transform(parts, lambda g, i: F.concat(g, F.size(F.filter(F.slice(parts, 1, i), lambda x: x == g)).cast("string")))

    pairs = F.when(F.length(form) > 1, F.transform(F.sequence(F.lit(1), F.length(form) - 1), lambda i: F.substring(form, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    chars = F.when(F.length(form) < short, F.filter(F.split(form, ""), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
    mark = lambda kind, parts: F.transform(T.bound(parts, numbered), lambda g: F.concat(F.lit(kind), g))
    return F.concat(mark("2", pairs), mark("1", chars))


def similar_names(forms: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(_form, _name, _r): pairs of forms and names (_name; compared in lower case) with an indel ratio of ``least`` or more.

    Of lengths n and m, such a pair has a common subsequence of L >= least * (n + m) / 200, hence 3 L - (n + m) - 1 common
    bigrams at least; where that is under one, the characters count instead, L of them. So pairs come from an equi-join
    on these, counted, and only those that reach the count are compared. ``least`` must be over 0.
    """
    share = least / 200
    # from this sum of lengths on, the bigrams' bound is 1 or more
    limit = math.ceil(2 / (3 * share - 1)) if 3 * share > 1 else 1 << 30
    token = lambda form: F.explode(_grams(F.col(form), limit)).alias("_token")
    left = forms.select("_form", F.length("_form").alias("_n"), token("_form"))
    right = names.select("_name", F.lower("_name").alias("_low")).select("_name", "_low", F.length("_low").alias("_m"), token("_low"))
    both = F.col("_n") + F.col("_m")
    need = F.ceil(F.lit(share) * both - 1e-9)
    fits = (2 * F.least("_n", "_m") >= 2 * F.lit(share) * both - 1e-9) & (F.when(both >= limit, "2").otherwise("1") == F.left("_token", F.lit(1)))
    met = left.join(right, "_token").filter(fits).groupBy("_form", "_name", "_low", "_n", "_m").agg(F.count("*").alias("_c"))
    close = met.filter(F.col("_c") >= F.when(both >= limit, 3 * need - both - 1).otherwise(need)).select("_form", "_name", "_low")
    return close.mapInArrow(_compared, "_form string, _name string, _r double").filter(F.col("_r") >= least)
