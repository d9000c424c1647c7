"""Search queries. The asked queries are the benchmark's texts; a document's vector is the embedding of the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import index as I
from ..operators import search as S
from ..operators.store import sent_if_small, written
from .registry import query
from .tables import table
from .text_queries import SEARCH_TOKENS, line_sql


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def bm25_sql(rows: str = "documents", key: str = "doc_id", asked: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    """CTEs up to bmr (query_id, ``key``, bm25, rank), of ``rows`` (``key``, text) and the queries ``asked``."""
    return f"""
tk AS (SELECT {key}, {SEARCH_TOKENS} AS t FROM {rows}),
post AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(t) AS term FROM tk) GROUP BY ALL),
dl AS (SELECT {key}, len(t) AS dl FROM tk),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df, (SELECT count(*) FROM {rows}) AS n FROM post GROUP BY term)),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({SEARCH_TOKENS}) AS term FROM ({asked})) GROUP BY ALL),
bm AS (SELECT query_id, {key}, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))) AS bm25 FROM q JOIN stats USING (term) JOIN post USING (term) JOIN dl USING ({key}) GROUP BY ALL),
bmr AS (SELECT query_id, {key}, round(bm25, 9) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, {key}) AS rank FROM bm)"""


BM25_SQL = bm25_sql()


_BUILT: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> I.Index:
    """The documents' index: built by the session's first search, read by the others."""
    return I.kept(spark, _BUILT, (spark.sparkContext.applicationId, d), "doc_id", lambda: I.build(_docs(spark, d), "doc_id", "text"))


def _bm(spark: SparkSession, d: str) -> DataFrame:
    return I.scores(_index(spark, d), _asked(spark, d))


def _top(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The ``k`` best documents of each query; few enough, they are sent to the texts they are joined with."""
    return sent_if_small(written(I.top(_index(spark, d), _asked(spark, d), k)))


@query("r1_term_statistics", f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM stats")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("r1_postings", f"WITH {BM25_SQL} SELECT term, doc_id, tf, dl FROM post JOIN dl USING (doc_id)")
def r1_postings(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(_index(spark, d))


@query("r2_bm25", f"WITH {BM25_SQL} SELECT query_id, doc_id, round(bm25, 5) AS bm25 FROM bm")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return _bm(spark, d).withColumn("bm25", F.round("bm25", 5))


@query("r7_search_documents", f"WITH {BM25_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(bm25, 5) AS bm25, left(text, 200) AS snippet FROM bmr JOIN documents USING (doc_id) WHERE rank <= 10")
def r7(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 10)
    return top.join(_docs(spark, d), "doc_id").select("query_id", "doc_id", "rank", F.round("bm25", 5).alias("bm25"), T.snippet(F.col("text"), 200).alias("snippet"))


VEC_SQL = """
dot AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN benchmark ON a.vec_id = item_id, embeddings b),
vr AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dot)"""


def _near(spark: SparkSession, d: str, k: int, other_only: bool = False) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qv"))
    return S.nearest(asked, v, "query_id", "qv", "doc_id", "embedding", k, other_only)


@query("r3_vector_search", f"WITH {VEC_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM vr WHERE rank <= 12")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 12).withColumn("score", F.round("score", 6))


def hybrid_sql(alpha: float) -> str:
    return f"""WITH {BM25_SQL}, {VEC_SQL},
cand AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.doc_id, b.doc_id) AS doc_id, coalesce(score, 0) AS v, coalesce(bm25, 0) AS b FROM (SELECT * FROM vr WHERE rank <= 12) v FULL JOIN (SELECT * FROM bmr WHERE rank <= 12) b ON v.query_id = b.query_id AND v.doc_id = b.doc_id),
mix AS (SELECT query_id, doc_id, round({alpha} * v + (1 - {alpha}) * CASE WHEN max(b) OVER w > 0 THEN b / (max(b) OVER w + 1e-6) ELSE b END, 9) AS score FROM cand WINDOW w AS (PARTITION BY query_id)),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM mix)"""


def _hybrid(spark: SparkSession, d: str, alpha: float) -> DataFrame:
    v = _near(spark, d, 12)
    b = _top(spark, d, 12)
    return S.hybrid(v, b, "query_id", "doc_id", alpha, 12).withColumn("score", F.round("score", 6))


def _register_hybrid(name: str, alpha: float) -> None:
    @query(name, f"{hybrid_sql(alpha)} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hr WHERE rank <= 12")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _hybrid(spark, d, alpha)


_register_hybrid("r4_hybrid_search", 0.55)


@query("r7_best_chunk_per_job", f"{hybrid_sql(0.55)}, one AS (SELECT query_id, doc_id, source, rank AS r FROM hr JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1) SELECT query_id, source, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM one QUALIFY rank <= 8")
def r7_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid candidates, the best chunk (document) of each job (source), the first 8 jobs of each query."""
    v = _near(spark, d, 12)
    b = _top(spark, d, 12)
    mixed = S.hybrid(v, b, "query_id", "doc_id", 0.55, 24).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return S.best_per_job(mixed, "query_id", "source", 8).select("query_id", "source", "doc_id", "rank")


_register_hybrid("r5_semantic_search", 1.0)
_register_hybrid("r5_keyword_search", 0.0)


@query("u1_candidate_union", f"WITH {BM25_SQL}, {VEC_SQL} SELECT query_id, doc_id FROM vr WHERE rank <= 12 UNION SELECT query_id, doc_id FROM bmr WHERE rank <= 12")
def u1_j3(spark: SparkSession, d: str) -> DataFrame:
    v = _near(spark, d, 12).select("query_id", "doc_id")
    return v.union(_top(spark, d, 12).select("query_id", "doc_id")).distinct()


@query("r6_filtered_search", f"WITH {BM25_SQL}, f AS (SELECT query_id, doc_id, round(bm25, 9) AS s FROM bm JOIN documents USING (doc_id) WHERE lang = 'fr'), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def r6(spark: SparkSession, d: str) -> DataFrame:
    met = _bm(spark, d).join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    return S.filtered(met, P.same_text(F.col("lang"), "fr"), "query_id", "doc_id", "bm25", 8).select("query_id", "doc_id", "rank")


@query("r6_post_filtered_search", f"WITH {BM25_SQL}, f AS (SELECT query_id, doc_id, rank FROM bmr JOIN documents USING (doc_id) WHERE rank <= 120 AND lang = 'fr'), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM f) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def r6_post(spark: SparkSession, d: str) -> DataFrame:
    met = _bm(spark, d).join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    return S.filtered(met, P.same_text(F.col("lang"), "fr"), "query_id", "doc_id", "bm25", 8, "post").select("query_id", "doc_id", "rank")


@query("r8_boolean_search", "SELECT doc_id, left(text, 200) AS snippet FROM documents WHERE (contains(lower(text || ' ' || chr(10) || ' ' || source), 'src1') OR contains(lower(text), 'of the')) AND NOT contains(lower(text), 'password')")
def r8_t7(spark: SparkSession, d: str) -> DataFrame:
    return S.boolean_search(_docs(spark, d), "doc_id", '(src1 OR "of the") AND NOT password', ["text", "source"])


@query("t7_first_matches", "SELECT doc_id, left(text, 200) AS snippet FROM documents WHERE contains(lower(text), 'of the') ORDER BY doc_id LIMIT 25")
def t7(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 documents, in corpus order, that meet a query."""
    return S.boolean_search(_docs(spark, d), "doc_id", '"of the"', ["text"], limit=25)


@query("f7_best_snippets", "WITH l AS (SELECT source AS job, doc_id, text FROM documents) SELECT job, left(coalesce(arg_min(text, doc_id) FILTER (contains(lower(text), 'password') OR contains(lower(text), 'akia')), arg_min(text, doc_id)), 200) AS snippet FROM l GROUP BY job")
def f7(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumnRenamed("source", "job")
    return S.best_snippet(docs, "job", "doc_id", "text", P.search_terms("password OR akia"))


@query("r9_search_inside_source", f"WITH {BM25_SQL}, f AS (SELECT query_id, doc_id, round(bm25, 9) AS s FROM bm JOIN documents USING (doc_id) WHERE source = 'src3'), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, left(text, 400) AS snippet FROM r JOIN documents USING (doc_id) WHERE rank <= 5")
def r9_j11(spark: SparkSession, d: str) -> DataFrame:
    met = _bm(spark, d).join(_docs(spark, d), "doc_id")
    return S.filtered(met, F.col("source") == "src3", "query_id", "doc_id", "bm25", 5).select("query_id", "doc_id", T.snippet(F.col("text"), 400).alias("snippet"))


@query("r10_similar_vectors", f"WITH {VEC_SQL}, o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dot WHERE doc_id <> query_id) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 5")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 5, other_only=True).select("query_id", "doc_id", "rank")


@query("r10_similar_jobs", f"WITH {VEC_SQL}, o AS (SELECT query_id, dot.doc_id, d.source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, dot.doc_id) AS r FROM dot JOIN documents d ON d.doc_id = dot.doc_id JOIN documents q ON q.doc_id = query_id WHERE d.source IS DISTINCT FROM q.source), one AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY r) = 1) SELECT query_id, source, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM one QUALIFY rank <= 5")
def r10_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The jobs (sources) most like each query's, its own left out, each once by its best row."""
    jobs = _docs(spark, d).select("doc_id", "source")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(jobs, "doc_id")
    asked = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("source").alias("own"))
    return S.nearest_groups(asked, v, "query_id", "qv", "doc_id", "embedding", "source", "own", 5).select("query_id", "source", "doc_id", "rank")


@query("r14_result_lists", f"WITH {BM25_SQL} SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids, string_agg('- ' || doc_id || ' @ ' || source, chr(10) ORDER BY rank) AS lines FROM bmr JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY query_id")
def r14(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 8).join(_docs(spark, d), "doc_id")
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("- "), "doc_id", F.lit(" @ "), "source").alias("line"))))
    return top.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.array_join("r.id", ",").alias("ids"), F.array_join("r.line", "\n").alias("lines"))


@query("r15_citation_answers", f"WITH {BM25_SQL} SELECT query_id, string_agg('[' || rank || '] ' || source || ': ' || left(text, 300), chr(10) ORDER BY rank) AS answer FROM bmr JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id")
def r15(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 5).join(_docs(spark, d), "doc_id")
    return S.citation_lines(top, "query_id", "rank", F.col("source"), F.col("text"))


@query("w1_best_per_source", f"WITH {BM25_SQL}, s AS (SELECT query_id, source, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM bmr JOIN documents USING (doc_id)) SELECT query_id, source, doc_id FROM s WHERE n = 1")
def w1(spark: SparkSession, d: str) -> DataFrame:
    scored = _bm(spark, d).withColumn("bm25", F.round("bm25", 9)).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return S.first_per(scored, ["query_id", "source"], [F.desc("bm25"), "doc_id"]).select("query_id", "source", "doc_id")


CONTENT_SQL = f"""WITH {BM25_SQL}, c AS (SELECT query_id, doc_id, rank, md5(lower({line_sql('text')})) AS cid FROM bmr JOIN documents USING (doc_id) WHERE rank <= 20)"""


@query("w2_distinct_contents", f"{CONTENT_SQL} SELECT cid, min(doc_id) AS doc_id, array_to_string(list_sort(list_distinct(list(query_id))), ',') AS matched FROM c GROUP BY cid")
def w2_u4(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 20).join(_docs(spark, d), "doc_id").withColumn("cid", F.md5(T.matching_form(F.col("text"))))
    out = S.merged_by_content(top.select("cid", "doc_id", "query_id"), "cid", "doc_id", "query_id")
    return out.select("cid", "doc_id", F.array_join("matched_queries", ",").alias("matched"))


@query("w3_budgeted_results", f"WITH {BM25_SQL}, c AS (SELECT query_id, doc_id, rank, sum(len(left(text, 500)) // 4 + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running_cost FROM bmr JOIN documents USING (doc_id) WHERE rank <= 50) SELECT query_id, doc_id, CAST(running_cost AS BIGINT) AS running_cost FROM c WHERE running_cost <= 4000")
def w3(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 50).join(_docs(spark, d), "doc_id")
    return S.within_budget(top, "query_id", "rank", T.token_estimate(T.snippet(F.col("text"), 500)), 4000).select("query_id", "doc_id", "running_cost")


@query("w4_character_budget", f"WITH {BM25_SQL}, c AS (SELECT query_id, doc_id, rank, sum(len(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running_cost FROM bmr JOIN documents USING (doc_id) WHERE rank <= 20) SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS used FROM c WHERE running_cost <= 12000 OR rank = 1 GROUP BY query_id")
def w4(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 20).join(_docs(spark, d), "doc_id")
    used = S.within_budget(top, "query_id", "rank", F.length("text"), 12000, keep_first=True)
    ids = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"))))
    return used.groupBy("query_id").agg(ids.alias("r")).select("query_id", F.array_join("r.id", ",").alias("used"))


@query("t5_reranked", f"WITH {BM25_SQL}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC NULLS LAST, rank) AS rank FROM bmr LEFT JOIN labels USING (doc_id) WHERE rank <= 20) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def t5(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 20)
    scores = top.select("query_id", "doc_id").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("relevance")), "doc_id")
    return S.reranked(top, scores, "query_id", "doc_id", 5).select("query_id", "doc_id", "rank")


@query("j6_expanded_jobs", f"WITH {BM25_SQL}, seeds AS (SELECT source, min(rank) AS job_rank FROM bmr JOIN documents USING (doc_id) WHERE query_id = 0 AND rank <= 3 GROUP BY source), m AS (SELECT source, doc_id, row_number() OVER (PARTITION BY md5(lower({line_sql('text')})) ORDER BY job_rank, doc_id) AS n FROM documents JOIN seeds USING (source)) SELECT source, doc_id FROM m WHERE n = 1")
def j6(spark: SparkSession, d: str) -> DataFrame:
    seeds = _top(spark, d, 3).filter("query_id = 0").join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    chunks = _docs(spark, d).withColumn("cid", F.md5(T.matching_form(F.col("text"))))
    return S.expanded(seeds.select("source", "rank"), chunks, "source", "rank", "doc_id", "cid").select("source", "doc_id")


@query("c20_language_votes", None)
def c20(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.profiles import function_word_language

    return function_word_language(_docs(spark, d), "doc_id", "text")


@query("c21_hashed_vectors", None)
def c21(spark: SparkSession, d: str) -> DataFrame:
    return S.hashed_vectors(_docs(spark, d), "doc_id", "text", 64)


@query("g10_first_appearance", "SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("source").agg(F.min("doc_id").alias("first_at")).orderBy("first_at")


@query("r16_chunks_of_source", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS pos FROM documents WHERE source = 'src7'")
def r16_w6(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("source = 'src7'").select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("pos"))
