"""Queries of the scalar functions and filters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from .registry import query
from .tables import table

LINE = r"regexp_replace(regexp_replace(coalesce({0}, ''), '[\s\x0b\x{{00a0}}\x{{0085}}\x{{2028}}\x{{2029}}]+', ' ', 'g'), '^ +| +$', '', 'g')"


def line_sql(c: str) -> str:
    return LINE.format(c)


_DECODE = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_TAGS = r"regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '{1}', 'g'), '(?s)<[A-Za-z/!?][^>]*>', '{1}', 'g')"


@query("c1_html_to_line", "SELECT page_id, " + line_sql(_DECODE.format(_TAGS.format("html", " "))) + " AS text FROM pages")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_to_line(F.col("html")).alias("text"))


_BLOCKS = r"regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\b[^>]*>', chr(10), 'g'), '(?i)<(?:p|li|div|h1|h2|h3|h4|h5|h6)\b[^>]*>', chr(10), 'g'), '(?i)</(?:p|li|div|h1|h2|h3|h4|h5|h6)\s*>', chr(10), 'g')"


@query("c2_html_to_lines", "SELECT page_id, array_to_string(list_transform(string_split(" + _DECODE.format(_TAGS.format(_BLOCKS, "")) + r", chr(10)), lambda x: regexp_replace(regexp_replace(x, '[\t\r\x{00a0}]+', ' ', 'g'), '^ +| +$', '', 'g')), chr(10)) AS text FROM pages")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_to_lines(F.col("html")).alias("text"))


@query("c3_single_line", f"SELECT doc_id, {line_sql('text')} AS line, lower({line_sql('text')}) AS matching FROM documents")
def c3_c4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.single_line(F.col("text")).alias("line"), T.matching_form(F.col("text")).alias("matching"))


@query("c5_soft_lines", "SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: " + line_sql("x") + "), lambda x: x <> '') AS l FROM documents))")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.soft_lines(F.col("text"))).alias("pos", "line"))


NGRAM_FORM = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s\-]', ' ', 'g'), '\s+', ' ', 'g'), '^ +| +$', '', 'g')"


@query("c6_ngram_form", f"SELECT doc_id, {NGRAM_FORM} AS form, CAST(len(list_filter(string_split({NGRAM_FORM}, ' '), lambda t: t <> '')) AS BIGINT) AS n_words FROM documents")
def c6_c8(spark: SparkSession, d: str) -> DataFrame:
    form = T.ngram_form(F.col("text"))
    return table(spark, d, "documents").select("doc_id", form.alias("form"), F.size(T.words(form)).cast("long").alias("n_words"))


SEARCH_TOKENS = r"regexp_extract_all(lower(text), '[A-Za-z0-9_#+.\-]+')"


@query("c7_search_tokens", f"SELECT doc_id, array_to_string({SEARCH_TOKENS}, ' ') AS tokens FROM documents")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.search_tokens(F.col("text")), " ").alias("tokens"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
#: Letters beyond ASCII become ``_``, which is no part of a token but of a word, so that RE2's word ends are those of all letters.
KEYWORD_TOKENS = r"list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\p{L}\p{M}\p{N}\p{Pc}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g'), '\b[a-zA-Z][a-zA-Z0-9+#.\-]+\b'), lambda t: len(t) > 2 AND NOT list_contains(" + STOP + ", t))"


@query("c9_keyword_tokens", f"SELECT doc_id, coalesce(array_to_string({KEYWORD_TOKENS}, ' '), '') AS tokens FROM documents")
def c9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.keyword_tokens(F.col("text")), " ").alias("tokens"))


@query("c10_ngrams", f"""
WITH w AS (SELECT doc_id, list_filter(string_split({NGRAM_FORM}, ' '), lambda t: t <> '') AS t FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, array_to_string(t[i : i + 2], ' ') AS ngram FROM w, unnest(generate_series(1, greatest(0, len(t) - 2))) AS s(i) WHERE len(t) >= 3""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("doc_id", T.words(T.ngram_form(F.col("text"))).alias("t"))
    return tokens.select("doc_id", F.posexplode(T.ngrams(F.col("t"), 3)).alias("pos", "ngram"))


@query("c11_ids", f"SELECT doc_id, md5(doc_id || '|0') AS chunk_id, md5(doc_id || '|' || lower({line_sql('text')})) AS chunk_id_v2 FROM documents")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"), T.content_id(F.col("doc_id"), F.col("text")).alias("chunk_id_v2"))


@query("c13_estimates_and_snippets", "SELECT doc_id, CAST(len(text) // 4 + 1 AS BIGINT) AS tokens, left(text, 150) AS s150, left(text, 200) AS s200, left(text, 300) AS s300, left(text, 500) AS s500 FROM documents")
def c13_c14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), *[T.snippet(F.col("text"), n).alias(f"s{n}") for n in (150, 200, 300, 500)])


@query("c19_url_mentions", r"""
SELECT page_id, url, CAST(min(pos) - 1 AS INTEGER) AS first_at FROM (
  SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) AS pos FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, 'https?://[^\s<>"]+') AS u FROM pages)) GROUP BY page_id, url""")
def c19(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select("page_id", F.posexplode(T.urls(F.concat_ws(" ", "url", "html"))).alias("pos", "url"))
    return found.groupBy("page_id", "url").agg(F.min("pos").alias("first_at"))


@query("f1_metadata_filters", "SELECT doc_id FROM documents WHERE contains(lower(lang), 'e') AND contains(lower(source), 'src1') AND contains(lower(text), 'tion')")
def f1_f3(spark: SparkSession, d: str) -> DataFrame:
    c = P.where(location=(F.col("lang"), "E"), company=(F.col("source"), "SRC1"), title=(F.col("text"), "tion"))
    return table(spark, d, "documents").filter(c).select("doc_id")


@query("f2_language_filter", "SELECT doc_id FROM documents WHERE lower(lang) = 'fr'")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(P.same_text(F.col("lang"), "FR")).select("doc_id")


@query("f4_phrase_filter", f"SELECT doc_id FROM documents WHERE contains(lower({line_sql('text')}), 'of the')")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(P.holds_phrase(F.col("text"), " of  THE ")).select("doc_id")


@query("f5_boolean_match", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'of the') AND contains(lower(text), 'ation')) OR (contains(lower(text), 'que') AND NOT contains(lower(text), 'und'))")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(P.boolean_match(F.col("text"), '("of the" AND ation) OR que NOT und')).select("doc_id")


@query("f13_minimum_length", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + line_sql("x") + "), lambda x: len(x) >= 20)) AS l FROM documents) GROUP BY doc_id")
def f13(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(T.soft_lines(F.col("text"))).alias("l"))
    return lines.filter(F.length("l") >= 20).groupBy("doc_id").agg(F.count("*").alias("n"))


def _intent_sql() -> str:
    rules = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in P.INTENTS)
    return f"CASE {rules} END"


@query("f15_intents", f"WITH i AS (SELECT conv_id, turn, {_intent_sql()} AS i FROM conversations) SELECT conv_id, turn, coalesce(i, 'search') AS intent, CASE WHEN i IS NULL THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence, CAST(CASE coalesce(i, 'search') WHEN 'search' THEN CASE WHEN turn > 10 THEN 0 ELSE 1 END WHEN 'explore' THEN 0 WHEN 'compare' THEN CASE WHEN turn <= 3 THEN 2 ELSE 1 END ELSE 3 END AS INTEGER) AS tier FROM i")
def f15_f16(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "conversations").select("conv_id", "turn", P.intent(F.col("text")).alias("i"))
    return out.select("conv_id", "turn", "i.intent", "i.confidence", P.context_tier(F.col("i.intent"), F.col("turn")).alias("tier"))
