"""Queries of sections, chunks, aspects and contexts. Documents stand for jobs: source for the company, first line for the title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aspects as A
from ..operators import chunking as C
from ..operators import context as X
from .chunk_sql import chunks_sql, sections_sql, whole_sql
from .ngram_queries import grams_sql
from .registry import query
from .search_queries import BM25_SQL
from .search_queries import _top as best_of
from .tables import table
from .text_queries import line_sql


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


VOCAB_SQL = f"vocab AS (SELECT ngram AS term FROM ({'WITH ' + grams_sql(1, 2) + ' SELECT ngram FROM grams WHERE frequency * 10000 >= total AND len(ngram) > 4'}))"


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The n-grams that are one in 10,000 or more of those of their length, at any size of the corpus."""
    from ..operators.ngrams import corpus_ngrams

    grams = corpus_ngrams(_docs(spark, d), "doc_id", "text", 1, 2).filter("frequency * 10000 >= total and length(ngram) > 4")
    return grams.select(F.lit("skills").alias("aspect"), F.col("ngram").alias("term"))


SOFT_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: " + line_sql("x") + "), lambda x: x <> '')"

SCORE_SQL = f"""
ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos, l FROM (SELECT doc_id, {SOFT_SQL} AS l FROM documents)),
w AS (SELECT *, list_filter(string_split(regexp_replace(line, ':+$', ''), ' '), lambda x: x <> '') AS ws, l[pos + 2 : pos + 4] AS nxt FROM ln),
sc AS (SELECT doc_id, pos, line, CASE WHEN line = '' OR len(line) > 60 OR (len(ws) < 2 AND NOT ends_with(line, ':')) THEN 0 ELSE
  CASE WHEN ends_with(line, ':') AND len(ws) <= 8 THEN 3 ELSE 0 END
  + CASE WHEN upper(line) = line AND lower(line) <> line AND len(line) > 3 THEN 2 ELSE 0 END
  + CASE WHEN len(ws) BETWEEN 2 AND 8 AND len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 0.6 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN len(list_filter(nxt, lambda x: regexp_matches(x, '^\\s*([•\\-*–]\\s+|\\d+\\.\\s+)'))) > 0 THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(line, '^\\d+\\.\\s+') THEN 1 ELSE 0 END END AS score FROM w)"""


@query("x3_header_scores", f"WITH {SCORE_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(score AS INTEGER) AS score FROM sc")
def x3(spark: SparkSession, d: str) -> DataFrame:
    return C.header_lines(C.lines(_docs(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "pos", "score")


@query("x1_sections", f"WITH {sections_sql('documents')} SELECT doc_id, text, start_line, end_line FROM sec")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(_docs(spark, d), "doc_id", "text").select("doc_id", "text", "start_line", "end_line")


#: Documents with two small headers put in, the second with bullets below.
_HEADED = "text || char(10) || 'Requirements:' || char(10) || text || char(10) || 'BENEFITS' || char(10) || '- ' || source || ' and pension' || char(10) || '- a long enough ' || lang"
_HEADED_SQL = f"hd AS (SELECT doc_id, {_HEADED.replace('char(10)', 'chr(10)')} AS text FROM documents)"


@query("x1_headed_sections", f"WITH {_HEADED_SQL}, {sections_sql('hd')} SELECT doc_id, name, raw_name, text, start_line, end_line FROM sec")
def x1_headed(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", F.expr(_HEADED).alias("text"))
    return C.sections(docs, "doc_id", "text").drop("section_no")


@query("x11_headed_chunks", f"WITH {_HEADED_SQL}, {chunks_sql('hd')} SELECT * FROM ch")
def x11_headed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents with headers and bullets."""
    return C.chunks(_docs(spark, d).select("doc_id", F.expr(_HEADED).alias("text")), "doc_id", "text")


@query("x6_structural_sections", f"WITH {sections_sql('documents', 'structural')} SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, name, raw_name, text, start_line, end_line FROM sec")
def x2_x6(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(_docs(spark, d), "doc_id", "text", "structural")


@query("x7_sentences", r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM s, unnest(generate_series(1, len(s))) AS t(i)")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("pos", "sentence"))


@query("x11_chunks", f"WITH {chunks_sql('documents')} SELECT * FROM ch")
def x8_x11(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(_docs(spark, d), "doc_id", "text")


@query("x11_chunks_with_metadata", None)
def x11_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the 14 fields of their document's metadata; those that documents lack are null."""
    from ..operators.profiles import function_word_language

    docs = _docs(spark, d)
    fields = docs.select("doc_id", F.get(T.soft_lines(F.col("text")), F.lit(0)).alias("title"), F.col("source").alias("company"), (F.col("doc_id") % 60).alias("days_old"), F.concat(F.lit("https://jobs.example/"), "doc_id").alias("jobUrl"))
    known = fields.join(function_word_language(docs, "doc_id", "text").withColumnRenamed("lang", "language"), "doc_id")
    out = C.with_metadata(C.chunks(docs, "doc_id", "text"), known, "doc_id")
    return out.select("doc_id", "order", "chunk_id", *[F.col(f"meta.{f}").alias(f) for f in C.META])


@query("x12_chunk_aspects", f"WITH {chunks_sql('documents', 'structural')}, {VOCAB_SQL}, h AS (SELECT chunk_id, string_agg(term, ',' ORDER BY term) AS v FROM ch JOIN vocab ON contains(lower(ch.text), term) GROUP BY chunk_id) SELECT doc_id, \"order\", section, coalesce(v, '') AS skills FROM ch LEFT JOIN h USING (chunk_id)")
def x12_aspects(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by structure with the vocabulary's terms in each."""
    rows = C.chunks(_docs(spark, d), "doc_id", "text", "structural")
    hits = A.vocabulary_hits(rows, "chunk_id", "text", _vocabulary(spark, d), "substring").withColumn("pos", F.row_number().over(Window.partitionBy("chunk_id").orderBy("term")))
    out = C.with_aspects(rows, "chunk_id", hits)
    return out.select("doc_id", "order", "section", F.array_join(F.coalesce(F.try_element_at("aspects", F.lit("skills")), F.array().cast("array<string>")), ",").alias("skills"))


@query("x12_structural_chunks", f"WITH {chunks_sql('documents', 'structural')} SELECT * FROM ch")
def x12(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(_docs(spark, d), "doc_id", "text", "structural")


def _cut_sql(before: str, now: str) -> str:
    return f"ltrim(substring({now}, 1 + list_max(list_filter(generate_series(0, least(250, len({before}), len({now}))), lambda n: starts_with({now}, right({before}, n)))), 300000))"


_C12 = f"""WITH p AS (
  SELECT doc_id, list_filter(list_transform(generate_series(1, greatest(1, len(text)), 300), lambda i: CASE WHEN i = 1 THEN left(text, 300) ELSE substring(text, i - 100, 400) END), lambda x, i: i = 1 OR len(x) > 100) AS p
  FROM documents WHERE text IS NOT NULL
), r AS (SELECT doc_id, i, p[i] AS now, p[i - 1] AS before FROM p, unnest(generate_series(1, len(p))) AS t(i)),
c AS (SELECT doc_id, i, CASE WHEN i = 1 THEN now ELSE {_cut_sql('before', 'now')} END AS part FROM r)
SELECT doc_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY i) FILTER (part <> ''), '') AS full_text FROM c GROUP BY doc_id"""


@query("c12_overlap_removed", _C12)
def c12(spark: SparkSession, d: str) -> DataFrame:
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(300))
    windows = F.transform(at, lambda i: F.when(i == 1, F.left("text", F.lit(300))).otherwise(F.substring(F.col("text"), i - 100, F.lit(400))))
    rows = _docs(spark, d).filter("text is not null").select("doc_id", F.posexplode(windows).alias("order", "text")).filter((F.col("order") == 0) | (F.length("text") > 100))
    return C.without_overlap(rows, "doc_id", "order", "text")


@query("x13_reassembled_sections", f"WITH {chunks_sql('documents')}, {whole_sql('ch', 160)}, {sections_sql('whole', 'structural')} SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, coalesce(name, 'intro') AS name, raw_name, text, start_line, end_line FROM sec")
def x13(spark: SparkSession, d: str) -> DataFrame:
    whole = C.without_overlap(C.chunks(_docs(spark, d), "doc_id", "text"), "doc_id", "order", "text", 160)
    return C.sections(whole, "doc_id", "full_text", "structural").withColumn("name", F.coalesce("name", F.lit("intro")))


@query("r13_job_details", f"WITH {chunks_sql('documents')}, {whole_sql('ch', 250)}, {sections_sql('whole', 'structural')}, n AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY doc_id), k AS (SELECT doc_id, count(*) AS k FROM sec GROUP BY doc_id) SELECT doc_id, lang, source, coalesce(n, 0) AS n_chunks, CAST(coalesce(k, 0) AS INTEGER) AS n_sections, md5(coalesce(whole.text, '')) AS text_md5 FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN whole USING (doc_id)")
def r13(spark: SparkSession, d: str) -> DataFrame:
    out = C.details(_docs(spark, d), "doc_id", "text")
    return out.select("doc_id", "lang", "source", "n_chunks", F.size("sections").alias("n_sections"), F.md5("full_text").alias("text_md5"))


@query("g9_assembled_texts", "SELECT doc_id, replace(text, chr(10), ' ') AS full_text FROM documents WHERE text IS NOT NULL")
def g9_t2(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("order", "line"))
    return C.assembled(lines, "doc_id", "order", "line")


@query("w5_labelling_texts", "SELECT source, left(string_agg(text, ' ' ORDER BY doc_id), 500) AS t FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY source")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return C.assembled(_docs(spark, d), "source", "doc_id", "text", most=3).select("source", T.snippet(F.col("full_text"), 500).alias("t"))


@query("f12_section_chunks", "SELECT source, doc_id, left(text, 300) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lower(lang) = 'de') WHERE n <= 10")
def f12(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("source", F.col("doc_id").alias("order"), F.col("lang").alias("section"), "text")
    return C.section_chunks(rows, "source", "DE").select("source", F.col("order").alias("doc_id"), "text")


@query("a8_vocabulary_substrings", f"WITH {VOCAB_SQL} SELECT doc_id, term, CAST(instr(lower(text), term) AS INTEGER) AS pos FROM documents JOIN vocab ON contains(lower(text), term)")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return A.vocabulary_hits(_docs(spark, d), "doc_id", "text", _vocabulary(spark, d), "substring").select("doc_id", "term", "pos")


#: The same words without look-around: a mark belongs to a word together with the word character that follows it.
WORDS_SQL = r"regexp_extract_all({}, '\.?[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_+#]|[.\-/&][\p{{L}}\p{{N}}_])*')"

_A7 = f"""WITH {VOCAB_SQL}, forms AS (SELECT term, array_to_string(w, ' ') AS form, len(w) AS n FROM (SELECT term, {WORDS_SQL.format('term')} AS w FROM vocab) WHERE len(w) > 0),
tok AS (SELECT doc_id, {WORDS_SQL.format('text')} AS t FROM documents),
span AS (SELECT doc_id, i - 1 AS pos, array_to_string(t[i : i + n - 1], ' ') AS span FROM tok, (SELECT DISTINCT n FROM forms), unnest(generate_series(1, len(t) - n + 1)) AS g(i)),
once AS (SELECT doc_id, lower(span) AS form, arg_min(span, pos) AS value, min(pos) AS pos FROM span WHERE lower(span) IN (SELECT form FROM forms) GROUP BY ALL)
SELECT doc_id, term, value, CAST(pos AS INTEGER) AS pos FROM once JOIN forms USING (form)"""


@query("a7_vocabulary_words", _A7)
def a7(spark: SparkSession, d: str) -> DataFrame:
    return A.vocabulary_hits(_docs(spark, d), "doc_id", "text", _vocabulary(spark, d)).select("doc_id", "term", "value", "pos")


@query("a10_corpus_aspects", None)
def a1_a10(spark: SparkSession, d: str) -> DataFrame:
    # dealt anew: some eighty patterns a text are more work than a large row group should give one task
    pages = table(spark, d, "pages").select("page_id", "html").repartition("page_id").select("page_id", T.html_to_lines(F.col("html")).alias("text"))
    return A.extract(pages, "page_id", "text", _vocabulary(spark, d))


@query("g3_aspect_distribution", f"WITH {VOCAB_SQL} SELECT term AS value, count(DISTINCT doc_id) AS n FROM documents JOIN vocab ON contains(lower(text), term) GROUP BY term ORDER BY n DESC, value LIMIT 50")
def g3(spark: SparkSession, d: str) -> DataFrame:
    hits = A.vocabulary_hits(_docs(spark, d), "doc_id", "text", _vocabulary(spark, d), "substring")
    return A.distribution(hits, "doc_id", _docs(spark, d), "skills")[0]


@query("g3_aspect_coverage", f"WITH {VOCAB_SQL}, h AS (SELECT DISTINCT doc_id FROM documents JOIN vocab ON contains(lower(text), term)) SELECT count(*) AS jobs_with_values, (SELECT count(DISTINCT doc_id) FROM documents) AS total, round(count(*) / greatest((SELECT count(DISTINCT doc_id) FROM documents), 1), 3) AS coverage FROM h")
def g3_coverage(spark: SparkSession, d: str) -> DataFrame:
    hits = A.vocabulary_hits(_docs(spark, d), "doc_id", "text", _vocabulary(spark, d), "substring")
    return A.distribution(hits, "doc_id", _docs(spark, d), "skills")[1]


@query("g4_aspect_values", f"WITH {VOCAB_SQL} SELECT DISTINCT term AS value FROM documents JOIN vocab ON contains(lower(text), term)")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return A.vocabulary_hits(_docs(spark, d), "doc_id", "text", _vocabulary(spark, d), "substring").select("value").distinct().orderBy("value")


@query("r11_side_by_side", f"WITH {VOCAB_SQL}, h AS (SELECT doc_id, string_agg(term, ',' ORDER BY term) AS v FROM documents JOIN vocab ON contains(lower(text), term) GROUP BY doc_id) SELECT doc_id, coalesce(v, '') AS \"values\" FROM labels LEFT JOIN h USING (doc_id)")
def r11(spark: SparkSession, d: str) -> DataFrame:
    hits = A.vocabulary_hits(_docs(spark, d), "doc_id", "text", _vocabulary(spark, d), "substring").withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("term")))
    return A.side_by_side(hits, table(spark, d, "labels").select("doc_id"), "doc_id", "skills").select("doc_id", F.array_join("values", ",").alias("values"))


@query("f8_jobs_with_skills", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'password') OR contains(lower(text), 'token')) AND contains(lower(lang), 'e')")
def f8(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.predicates import has_text

    vocab = spark.createDataFrame([("skills", "password"), ("skills", "token")], "aspect string, term string")
    hits = A.vocabulary_hits(_docs(spark, d), "doc_id", "text", vocab, "substring")
    return A.filter_jobs(_docs(spark, d), hits, "doc_id", ["Password", "token"], None, has_text(F.col("lang"), "E")).select("doc_id")


def _context_sql(tier: int) -> str:
    most, chars, _ = X.TIERS[tier]
    head = "'[' || rank || '] ' || left(text, 20) || ' — ' || source || ' [' || lang || ']'" if tier == 1 else "'## ' || left(text, 20) || ' — ' || source" + (" || ' [' || lang || ']'" if tier == 2 else "")
    return f"""WITH {BM25_SQL}, b AS (SELECT query_id, rank, {head} || chr(10) || left(text, {chars}) AS p FROM bmr JOIN documents USING (doc_id) WHERE rank <= {most}),
c AS (SELECT *, sum(len(p) // 4 + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cost FROM b)
SELECT query_id, string_agg(p, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_used FROM c WHERE cost <= 4000 GROUP BY query_id"""


def _register_context(tier: int) -> None:
    @query(f"v{tier + 1}_context", _context_sql(tier))
    def run(spark: SparkSession, d: str) -> DataFrame:
        top = best_of(spark, d, X.TIERS[tier][0]).join(_docs(spark, d), "doc_id")
        part = X.block(tier, F.col("rank"), F.left("text", F.lit(20)), F.col("source"), F.col("text"), F.col("lang"))
        return X.context(top, tier, "query_id", "rank", part)


for _tier in (1, 2, 3):
    _register_context(_tier)


@query("v1_summary_context", f"WITH {BM25_SQL}, b AS (SELECT query_id, rank, '- ' || left(text, 20) || ' @ ' || source || ' | lang: ' || lang || ' | kw: a, b' AS p FROM bmr JOIN documents USING (doc_id) WHERE rank <= 50), c AS (SELECT *, sum(len(p) // 4 + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cost FROM b) SELECT query_id, string_agg(p, chr(10) ORDER BY rank) AS context, count(*) AS n_used FROM c WHERE cost <= 4000 GROUP BY query_id")
def v1(spark: SparkSession, d: str) -> DataFrame:
    top = best_of(spark, d, 50).join(_docs(spark, d), "doc_id")
    line = T.summary_line(F.left("text", F.lit(20)), F.col("source"), F.create_map(F.lit("lang"), F.array("lang")), F.array(F.lit("a"), F.lit("b")))
    return X.context(top, 0, "query_id", "rank", line)
