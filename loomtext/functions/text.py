"""Text functions on columns: cleaning, tokenising, n-grams, ids, snippets. All of them pass nulls on as empty text."""

from __future__ import annotations

import html as _html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and word lists of the data formats.
SEARCH_TOKEN = r"[A-Za-z0-9_#+.\-]+"
KEYWORD_TOKEN = r"(?U)\b[a-zA-Z][a-zA-Z0-9+#.-]+\b"
# The keyword extractor's stop words, in the order of the data format.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need", "must", "this",
    "that", "these", "those", "we", "you", "they", "it", "its", "our", "your", "their", "as", "if", "not", "no", "so", "up", "out", "about", "into",
    "over", "after", "such", "also", "more", "other",
)
NAMED_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
BLOCK_TAGS = "p|li|div|h1|h2|h3|h4|h5|h6"

_SPACE = r"(?U)\s+"
#: White space that is no single blank between others.
_LOOSE = r"(?U)[\s&&[^ ]]|  |^ | $"


@F.pandas_udf(StringType())
def _unescaped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(_html.unescape, na_action="ignore")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often a lambda in ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def decoded(c: Column) -> Column:
    """The common named entities decoded; ``&amp;`` last, so that nothing is decoded twice."""
    for name, char in NAMED_ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def decoded_fully(c: Column) -> Column:
    """Every entity, numeric ones too; only texts that have one leave the JVM (put a filter on ``&`` before it)."""
    return _unescaped(c)


def without_tags(c: Column, instead: str) -> Column:
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", instead)
    return F.regexp_replace(c, r"(?s)<[A-Za-z/!?][^>]*>", instead)


def single_line(c: Column) -> Column:
    """White space, no-break spaces too, collapsed to single blanks. Texts where nothing is to collapse aren't built anew."""
    return bound(text_or_empty(c), lambda x: F.when(x.rlike(_LOOSE), F.regexp_replace(F.regexp_replace(x, _SPACE, " "), "^ +| +$", "")).otherwise(x))


def html_to_line(c: Column) -> Column:
    return single_line(decoded(without_tags(text_or_empty(c), " ")))


def html_to_lines(c: Column) -> Column:
    """Plain text with a line break for ``br`` and around block elements; each line trimmed."""
    c = F.regexp_replace(text_or_empty(c), r"(?i)<br\b[^>]*>", "\n")
    c = F.regexp_replace(c, rf"(?i)<(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    c = F.regexp_replace(c, rf"(?i)</(?:{BLOCK_TAGS})\s*>", "\n")
    lines = F.split(decoded(without_tags(c, "")), "\n")
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"[\t\r ]+", " "), "^ +| +$", "")), "\n")


def matching_form(c: Column) -> Column:
    return F.lower(single_line(c))


def soft_lines(c: Column) -> Column:
    """Lines without tags, white space collapsed, blank ones dropped."""
    lines = F.split(text_or_empty(c), "\n")
    # a tag begins with <, which few lines have
    return F.filter(F.transform(lines, lambda x: single_line(F.when(x.contains("<"), without_tags(x, " ")).otherwise(x))), lambda x: x != "")


def ngram_form(c: Column, lowercase: bool = True, remove_punctuation: bool = True) -> Column:
    c = text_or_empty(c)
    if lowercase:
        c = F.lower(c)
    if remove_punctuation:
        c = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s\-]", " ")
    return single_line(c)


def search_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(SEARCH_TOKEN), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), " "), lambda t: t != "")


def keyword_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(KEYWORD_TOKEN), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def ngrams(tokens: Column, n: int) -> Column:
    """Sliding n-grams joined by a blank; none if there are fewer tokens.

    ``tokens`` must be a column of an earlier select: an expression in its place would be computed for every n-gram.
    """
    some = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>"))


def chunk_id(key: Column, order: Column) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), order.cast("string")))


def content_id(key: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), matching_form(text)))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(text_or_empty(c)) / 4) + 1


def snippet(c: Column, n: int) -> Column:
    return F.substring(text_or_empty(c), 1, n)


def fenced_json(answer: Column, schema: str) -> Column:
    """The record in the first fence of a markdown answer, or in the whole answer without one; null if it can't be read."""
    body = F.regexp_extract(text_or_empty(answer), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(body != "", F.trim(body)).otherwise(F.trim(answer)), schema, {"mode": "PERMISSIVE"})


def citations(c: Column) -> Column:
    """The distinct ``[n]`` of an answer, in order of their first mention; a number beyond an int is none."""
    found = F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda i: i.isNotNull()))


def cited(sources: Column, indices: Column) -> Column:
    """Sources that are cited (from 1, in the order of citing); all of them if none is."""
    some = F.filter(indices, lambda i: (i >= 1) & (i <= F.size(sources)))
    return F.when(F.size(some) > 0, F.transform(some, lambda i: F.element_at(sources, i))).otherwise(sources)


def urls(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(r'https?://[^\s<>"]+'), F.lit(0))


def summary_line(title: Column, company: Column, aspects: Column, keywords: Column) -> Column:
    """``- title @ company | aspect: a, b, c; ... | kw: x, y``: at most three values of each aspect and five keywords."""
    head = F.concat(F.lit("- "), F.coalesce(title, F.lit("?")), F.lit(" @ "), F.coalesce(company, F.lit("?")))
    parts = F.transform(F.filter(F.array_sort(F.map_entries(aspects)), lambda e: F.size(e["value"]) > 0), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(F.slice(e["value"], 1, 3), ", ")))
    kw = F.when(F.size(keywords) > 0, F.concat(F.lit("kw: "), F.array_join(F.slice(keywords, 1, 5), ", ")))
    return F.concat_ws(" | ", head, F.when(F.size(parts) > 0, F.array_join(parts, "; ")), kw)
