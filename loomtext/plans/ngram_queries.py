"""Queries of n-gram statistics and keywords. The target corpus is the English documents, the rest is the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ngrams as N
from ..operators import tfidf as K
from ..operators.matching import term_hits
from .registry import query
from .tables import table
from .text_queries import KEYWORD_TOKENS, NGRAM_FORM, STOP


def _docs(spark: SparkSession, d: str, c: str = "true") -> DataFrame:
    return table(spark, d, "documents").filter(c).select("doc_id", "text", "lang", "source")


def grams_sql(n_min: int, n_max: int, c: str = "true", name: str = "") -> str:
    """CTEs tok, per (doc_id, ngram, ngram_length, tf), grams (with total) of the documents that meet ``c``."""
    per = " UNION ALL ".join(f"SELECT doc_id, array_to_string(t[i : i + {n - 1}], ' ') AS ngram, {n} AS ngram_length FROM tok{name}, unnest(generate_series(1, greatest(0, len(t) - {n - 1}))) AS s(i) WHERE len(t) >= {n}" for n in range(n_min, n_max + 1))
    return f"""
tok{name} AS (SELECT doc_id, list_filter(string_split({NGRAM_FORM}, ' '), lambda t: t <> '') AS t FROM documents WHERE {c}),
per{name} AS (SELECT doc_id, ngram, CAST(ngram_length AS INTEGER) AS ngram_length, count(*) AS tf FROM ({per}) GROUP BY ALL),
sums{name} AS (SELECT ngram, ngram_length, CAST(sum(tf) AS BIGINT) AS frequency, count(*) AS document_frequency FROM per{name} GROUP BY ALL),
grams{name} AS (SELECT *, CAST(sum(frequency) OVER (PARTITION BY ngram_length) AS BIGINT) AS total FROM sums{name})"""


@query("g5_corpus_ngrams", f"WITH {grams_sql(1, 3)} SELECT * FROM grams WHERE frequency >= 3")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return N.corpus_ngrams(_docs(spark, d), "doc_id", "text", 1, 3, 3)


@query("g6_document_ngrams", f"WITH {grams_sql(1, 2)} SELECT * FROM per WHERE tf > 1")
def g6(spark: SparkSession, d: str) -> DataFrame:
    return N.document_ngrams(_docs(spark, d), "doc_id", "text", 1, 2).filter("tf > 1")


@query("g7_unigram_counts", f"WITH {grams_sql(1, 1)} SELECT ngram AS word, frequency FROM grams")
def g7(spark: SparkSession, d: str) -> DataFrame:
    return N.unigram_counts(_docs(spark, d), "text")


MI_SQL = grams_sql(2, 3) + f""",
uni AS (SELECT ngram AS word, frequency FROM ({'WITH ' + grams_sql(1, 1, name='1') + ' SELECT * FROM grams1'})),
logs AS (SELECT ngram, sum(log2(u.frequency / (SELECT sum(frequency) FROM uni))) AS lw FROM (SELECT ngram, unnest(string_split(ngram, ' ')) AS word FROM grams WHERE frequency >= 5) JOIN uni u USING (word) GROUP BY ngram),
mi AS (SELECT g.*, log2(frequency / total) - lw AS mi FROM grams g JOIN logs USING (ngram)),
scored AS (SELECT *, mi / -log2(frequency / total) AS npmi FROM mi)"""


#: As MI_SQL, but n-grams with a word of under 5 occurrences, which cannot have 5 themselves, aren't built.
_M3 = f"""WITH tok AS (SELECT doc_id, list_filter(string_split({NGRAM_FORM}, ' '), lambda t: t <> '') AS t FROM documents),
pos AS MATERIALIZED (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM tok),
uni AS MATERIALIZED (SELECT word, count(*) AS f, (SELECT count(*) FROM pos) AS words FROM pos GROUP BY word),
p AS (SELECT doc_id, word AS w1, f AS f1, lead(word) OVER d AS w2, lead(f) OVER d AS f2, lead(word, 2) OVER d AS w3, lead(f, 2) OVER d AS f3, log2(f / words) AS l1, log2(lead(f) OVER d / words) AS l2, log2(lead(f, 2) OVER d / words) AS l3 FROM pos JOIN uni USING (word) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
per AS (
  SELECT w1 || ' ' || w2 AS ngram, 2 AS ngram_length, doc_id, count(*) AS tf, any_value(l1 + l2) AS lw FROM p WHERE least(f1, f2) >= 5 AND w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT w1 || ' ' || w2 || ' ' || w3, 3, doc_id, count(*), any_value(l1 + l2 + l3) FROM p WHERE least(f1, f2, f3) >= 5 AND w3 IS NOT NULL GROUP BY ALL),
sums AS (SELECT ngram, ngram_length, CAST(sum(tf) AS BIGINT) AS frequency, count(*) AS document_frequency, any_value(lw) AS lw FROM per GROUP BY ngram, ngram_length HAVING sum(tf) >= 5),
tot AS (SELECT n AS ngram_length, CAST(sum(greatest(0, len(t) - n + 1)) AS BIGINT) AS total FROM tok, (VALUES (2), (3)) AS v(n) GROUP BY n),
mi AS (SELECT *, log2(frequency / total) - lw AS mi FROM sums JOIN tot USING (ngram_length))
SELECT ngram, CAST(ngram_length AS INTEGER) AS ngram_length, frequency, document_frequency, total, round(mi, 6) AS mi, round(mi / -log2(frequency / total), 6) AS npmi FROM mi"""


@query("m3_mutual_information", _M3)
def m1_m3(spark: SparkSession, d: str) -> DataFrame:
    return N.mutual_information(_docs(spark, d), "doc_id", "text").withColumns({c: F.round(c, 6) for c in ("mi", "npmi")})


Z_SQL = f"{MI_SQL}, z AS (SELECT *, CASE WHEN count(mi) OVER w < 2 THEN mi WHEN stddev_pop(mi) OVER w = 0 THEN 0 ELSE (mi - avg(mi) OVER w) / stddev_pop(mi) OVER w END AS mi_z FROM scored WINDOW w AS (PARTITION BY ngram_length))"


@query("m5_standardised_mi", f"WITH {Z_SQL} SELECT ngram, round(mi_z, 5) AS mi_z FROM z")
def m4_m5(spark: SparkSession, d: str) -> DataFrame:
    return N.standardised_by_length(N.mutual_information(_docs(spark, d), "doc_id", "text")).select("ngram", F.round("mi_z", 5).alias("mi_z"))


CMP_SQL = grams_sql(1, 2, "lang = 'en'") + "," + grams_sql(1, 2, "lang <> 'en'", "r") + """,
met AS (SELECT g.ngram, g.ngram_length, g.frequency, g.document_frequency, g.total AS n1, coalesce(r.frequency, 0) AS f2, (SELECT max(total) FROM gramsr) AS n2 FROM grams g LEFT JOIN gramsr r USING (ngram) WHERE g.frequency >= 2),
p AS (SELECT *, frequency / n1 AS p1, f2 / n2 AS p2, (frequency + f2) / (n1 + n2) AS p FROM met),
cmp AS (SELECT ngram, ngram_length, frequency, document_frequency, n1 AS total, f2 AS freq_reference, log2(((frequency + 0.5) / (n1 + 1)) / ((f2 + 0.5) / (n2 + 1))) AS effect_size,
  CASE WHEN f2 = 0 THEN 0 ELSE greatest(0, 2 * (frequency * (ln(p1) - ln(p)) + (n1 - frequency) * (ln(1 - p1) - ln(1 - p)) + f2 * (ln(p2) - ln(p)) + (n2 - f2) * (ln(1 - p2) - ln(1 - p)))) END AS g FROM p)"""


def _compared(spark: SparkSession, d: str, with_p: bool = False) -> DataFrame:
    target = N.corpus_ngrams(_docs(spark, d, "lang = 'en'"), "doc_id", "text", 1, 2, 2)
    return N.compare(target, N.corpus_ngrams(_docs(spark, d, "lang <> 'en'"), "doc_id", "text", 1, 2), with_p)


@query("m8_compare_corpora", f"WITH {CMP_SQL} SELECT ngram, frequency, freq_reference, round(effect_size, 6) AS effect_size, round(g, 4) AS g_stat, g > 3.841458820694124 AS significant FROM cmp")
def m6_m8(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("ngram", "frequency", "freq_reference", F.round("effect_size", 6).alias("effect_size"), F.round("g_stat", 4).alias("g_stat"), "significant")


#: erfc(x) = 1 - erf(x), and erf by its series of positive terms; beyond g = 200 it is nought to any digit shown.
_ERF_SQL = "list_sum(list_transform(generate_series(0, 400), lambda k: exp(ln(2 / sqrt(pi())) - g / 2 + 2 * k * ln(2) + (2 * k + 1) * ln(g / 2) / 2 + lgamma(k + 1) - lgamma(2 * k + 2))))"


@query("m7_p_values", f"WITH {CMP_SQL} SELECT ngram, round(CASE WHEN g <= 0 THEN 1 WHEN g > 200 THEN 0 ELSE greatest(0, 1 - {_ERF_SQL}) END, 6) AS p_value FROM cmp")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, True).select("ngram", F.round("p_value", 6).alias("p_value"))


@query("f9_word_filter", f"WITH {grams_sql(2, 2)} SELECT ngram, frequency FROM grams WHERE NOT list_has_any(string_split(ngram, ' '), ['the', 'of', 'and'])")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return N.filter_by_words(N.corpus_ngrams(_docs(spark, d), "doc_id", "text", 2, 2), forbidden=["the", "of", "and"]).select("ngram", "frequency")


@query("f10_meaningful_phrases", f"WITH {Z_SQL} SELECT ngram, frequency, document_frequency FROM z WHERE frequency >= 3 AND document_frequency >= 2 AND round(mi_z, 9) >= 0")
def f10(spark: SparkSession, d: str) -> DataFrame:
    scored = N.standardised_by_length(N.mutual_information(_docs(spark, d), "doc_id", "text")).withColumn("mi_z", F.round("mi_z", 9))
    return N.meaningful(scored).select("ngram", "frequency", "document_frequency")


@query("f11_phrase_whitelist", f"WITH {MI_SQL} SELECT ngram FROM scored WHERE ngram_length = 2 AND round(npmi, 9) BETWEEN 0.1 AND 1")
def f11(spark: SparkSession, d: str) -> DataFrame:
    scored = N.mutual_information(_docs(spark, d), "doc_id", "text", n_max=2)
    return N.whitelist(scored.select("ngram"), scored.select("ngram", F.round("npmi", 9).alias("npmi"), F.lit(0.0).alias("effect_size")), (0.1, 1.0), (0.0, 1.0))


_G8 = f"""WITH t AS (SELECT doc_id, {KEYWORD_TOKENS} AS t FROM documents),
f AS (SELECT doc_id, t[i] AS term, i, len(t) AS total FROM t, unnest(range(1, len(t) + 1)) AS s(i)),
c AS (SELECT doc_id, term, count(*) AS n, min(i) AS first, any_value(total) AS total FROM f GROUP BY ALL)
SELECT doc_id, term, round(n / total, 4) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM c QUALIFY rank <= 10"""


@query("g8_frequency_keywords", _G8)
def g8(spark: SparkSession, d: str) -> DataFrame:
    return K.frequency_keywords(_docs(spark, d), "doc_id", "text").withColumn("score", F.round("score", 4))


#: \w is ASCII in RE2, so tokens are the maximal runs of word characters instead.
TERMS_SQL = f"""
tk AS (SELECT {{key}} AS key, list_filter(regexp_extract_all(lower(text), '[\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}_]+'), lambda t: len(t) > 1 AND NOT list_contains({STOP}, t)) AS t FROM documents),
terms AS (SELECT key, term, count(*) AS tf FROM (
  SELECT key, unnest(t) AS term FROM tk
  UNION ALL SELECT key, t[i] || ' ' || t[i + 1] FROM tk, unnest(generate_series(1, greatest(0, len(t) - 1))) AS s(i) WHERE len(t) >= 2) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS freq FROM terms GROUP BY term),
feats AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT *, (SELECT count(DISTINCT key) FROM tk) AS n FROM df ORDER BY freq DESC, term LIMIT 10000)),
w AS (SELECT key, term, tf * idf AS w FROM terms JOIN feats USING (term)),
scored AS (SELECT key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 9) AS score FROM w),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, term) AS INTEGER) AS rank FROM scored WHERE score > 0)"""


@query("m10_tfidf_keywords", f"WITH {TERMS_SQL.format(key='doc_id')} SELECT key AS doc_id, term, rank, round(score, 6) AS score FROM best WHERE rank <= 15")
def m10_m11(spark: SparkSession, d: str) -> DataFrame:
    return K.tfidf_keywords(_docs(spark, d), "doc_id", "text", 15).withColumn("score", F.round("score", 6))


@query("m12_class_tfidf", f"WITH {TERMS_SQL.format(key='source')} SELECT key AS source, term, rank, round(score, 6) AS score FROM best WHERE rank <= 10")
def m12(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("cluster", F.regexp_extract("source", r"(\d+)", 1).cast("int"))
    out = K.class_tfidf(docs, "cluster", "text", 10)
    return out.select(F.concat(F.lit("src"), "cluster").alias("source"), "term", "rank", F.round("score", 6).alias("score"))


@query("k7_cluster_labels", f"WITH {TERMS_SQL.format(key='source')} SELECT key AS source, string_agg(term, ', ' ORDER BY rank) AS label FROM best WHERE rank <= 3 GROUP BY key")
def k7(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("cluster", F.regexp_extract("source", r"(\d+)", 1).cast("int"))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ")
    return K.class_tfidf(docs, "cluster", "text", 3).groupBy(F.concat(F.lit("src"), "cluster").alias("source")).agg(label.alias("label"))


@query("m9_keyword_aspect_mi", f"""
WITH {TERMS_SQL.format(key='doc_id')},
y AS (SELECT doc_id AS key, CAST(quality AS BIGINT) AS y FROM labels WHERE quality IS NOT NULL),
k AS (SELECT key, term, CAST(1 AS BIGINT) AS n FROM best WHERE rank <= 15),
top AS (SELECT term FROM k GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000),
base AS (SELECT count(*) AS docs, sum(y) AS ones FROM y),
cells AS (SELECT term, count(*) AS c, sum(y.y) AS c1 FROM k JOIN top USING (term) JOIN y USING (key) GROUP BY term),
every AS (SELECT * FROM cells UNION ALL SELECT term, docs - c, ones - c1 FROM cells, base),
mi AS (SELECT term, sum(CASE WHEN c1 > 0 THEN c1 / docs * ln(c1 * docs / (c * ones)) ELSE 0 END + CASE WHEN c - c1 > 0 THEN (c - c1) / docs * ln((c - c1) * docs / (c * (docs - ones))) ELSE 0 END) AS mi FROM every, base WHERE c > 0 GROUP BY term)
SELECT term, round(mi, 8) AS mi FROM mi WHERE mi > 1e-12""")
def m9(spark: SparkSession, d: str) -> DataFrame:
    words = K.tfidf_keywords(_docs(spark, d), "doc_id", "text", 15).select("doc_id", "term", F.lit(1).cast("long").alias("n"))
    y = table(spark, d, "labels").filter("quality is not null").select("doc_id", F.col("quality").cast("long").alias("y"))
    return K.keyword_aspect_mi(words, y, "doc_id").withColumn("mi", F.round("mi", 8))


@query("t3_top_values", f"WITH {grams_sql(1, 1)} SELECT ngram AS word, frequency FROM grams ORDER BY frequency DESC, word LIMIT 50")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return N.unigram_counts(_docs(spark, d), "text").orderBy(F.desc("frequency"), "word").limit(50)


@query("t4_top_terms_per_document", f"WITH {grams_sql(1, 1)}, r AS (SELECT doc_id, ngram, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, ngram) AS rank FROM per) SELECT doc_id, ngram, tf, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def t4(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "ngram"))
    return N.document_ngrams(_docs(spark, d), "doc_id", "text", 1, 1).withColumn("rank", rank).filter("rank <= 5").select("doc_id", "ngram", "tf", "rank")


@query("j10_terms_in_phrases", f"WITH {grams_sql(1, 1)}, p AS (SELECT DISTINCT ngram AS phrase FROM ({'WITH ' + grams_sql(2, 2, name='2') + ' SELECT * FROM grams2 WHERE frequency >= 20'})) SELECT DISTINCT g.ngram AS term FROM grams g JOIN p ON contains(p.phrase, g.ngram) WHERE g.frequency >= 50")
def j10(spark: SparkSession, d: str) -> DataFrame:
    terms = N.unigram_counts(_docs(spark, d), "text").filter("frequency >= 50").select(F.col("word").alias("term"))
    phrases = N.corpus_ngrams(_docs(spark, d), "doc_id", "text", 2, 2, 20).select("ngram")
    return term_hits(phrases, "ngram", "ngram", terms).select("term").distinct()


@query("u5_distinct_words", f"WITH {grams_sql(1, 1)} SELECT DISTINCT ngram AS word FROM grams")
def u5(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode(T.words(T.ngram_form(F.col("text")))).alias("word")).distinct()
