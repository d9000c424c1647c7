"""Queries of listings, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as X
from ..operators import labels as L
from .registry import query
from .tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("g1_jobs_of_chunks", "SELECT source, arg_min(lang, doc_id) AS lang, left(arg_min(text, doc_id), 100) AS first_text, count(*) AS n_chunks FROM documents GROUP BY source")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"), T.snippet(F.min_by("text", "doc_id"), 100).alias("first_text"), F.count("*").alias("n_chunks"))


@query("g2_language_histogram", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY lang")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("lang <> ''").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("g15_sections_of_jobs", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS sections FROM documents GROUP BY source")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("sections"))


@query("r12_job_summaries", "SELECT source, count(*) AS n_chunks, left(string_agg(text, ' ' ORDER BY doc_id), 500) AS preview FROM documents GROUP BY source")
def r12(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.chunking import preview

    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("n_chunks")).join(preview(_docs(spark, d), "source", "doc_id", "text"), "source", "left")


@query("t1_page_of_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(50)


@query("t1_page_with_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def t1_total(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "orders").agg(F.count("*").alias("total"))  # one row
    return t1(spark, d).crossJoin(F.broadcast(total))


@query("t6_selected_first", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY (o_orderkey % 7 = 0) DESC, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderstatus = 'F' QUALIFY place <= 100")
def t6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    top = rows.withColumn("is_selected", F.col("o_orderkey") % 7 == 0).orderBy(F.desc("is_selected"), F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("is_selected"), F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("j4_batch_fetch", "WITH ids AS (SELECT l_orderkey AS id, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem) SELECT CAST(pos AS BIGINT) AS pos, o_orderkey, o_custkey FROM ids JOIN orders ON id = o_orderkey")
def j4(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.store import numbered

    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    asked = numbered(ids, ["o_orderkey", "l_linenumber"], "pos").drop("l_linenumber")
    return asked.join(table(spark, d, "orders"), "o_orderkey").select("pos", "o_orderkey", "o_custkey").orderBy("pos")


@query("j5_selected_details", "SELECT source, doc_id, left(text, 300) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IN ('src1', 'src5')) WHERE n <= 2")
def j5(spark: SparkSession, d: str) -> DataFrame:
    chosen = spark.createDataFrame([("src1",), ("src5",), ("src1",), ("none",)], "source string")
    rows = _docs(spark, d).join(chosen, "source", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return rows.filter("n <= 2").select("source", "doc_id", T.snippet(F.col("text"), 300).alias("text"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "labels")
    parts = [y.filter(f"{c} = 1").select("doc_id", F.lit(c).alias("label")) for c in ("quality", "toxic")]
    return parts[0].union(parts[1])


LABELS_SQL = "lab AS (SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"


@query("g13_label_summary", f"WITH {LABELS_SQL} SELECT array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, count(DISTINCT doc_id) AS n_jobs FROM lab")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return L.summary(_labels(spark, d), "doc_id").withColumn("labels", F.array_join("labels", ","))


@query("g14_label_shares", f"WITH {LABELS_SQL}, s AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM lab WHERE label = 'toxic') AS h FROM documents WHERE source = 'src2') SELECT bool_and(h) AS all_have, bool_or(h) AS any_has, count(*) FILTER (h) AS n_have FROM s")
def g14(spark: SparkSession, d: str) -> DataFrame:
    return L.share(_docs(spark, d).filter("source = 'src2'").select("doc_id"), _labels(spark, d), "toxic", "doc_id")


@query("f14_label_filter", f"WITH {LABELS_SQL} SELECT DISTINCT doc_id FROM documents JOIN lab USING (doc_id) WHERE label = 'toxic'")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return L.with_any(_docs(spark, d), _labels(spark, d), ["toxic"], "doc_id").select("doc_id")


@query("j7_enriched_rows", f"WITH {LABELS_SQL}, l AS (SELECT doc_id, string_agg(label, ', ' ORDER BY label) AS labels FROM lab GROUP BY doc_id) SELECT doc_id, coalesce(labels, '') AS labels, lang = 'fr' AS is_selected FROM documents LEFT JOIN l USING (doc_id)")
def j7(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return L.enriched(docs.select("doc_id"), _labels(spark, d), docs.filter("lang = 'fr'").select("doc_id"), "doc_id")


ACTIONS_SQL = "log AS (SELECT event_id AS seq, user_id AS job_id, event_type AS label, CASE WHEN value > 50 THEN 'add' ELSE 'remove' END AS action FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("job_id"), F.col("event_type").alias("label"), F.when(F.col("value") > 50, "add").otherwise("remove").alias("action"))


@query("u2_label_actions", f"WITH {ACTIONS_SQL} SELECT job_id, label FROM (SELECT *, row_number() OVER (PARTITION BY job_id, label ORDER BY seq DESC) AS n FROM log) WHERE n = 1 AND action = 'add'")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return L.fold_actions(_log(spark, d))


@query("u3_replaced_labels", "SELECT DISTINCT user_id AS job_id, event_type AS label FROM events")
def u3(spark: SparkSession, d: str) -> DataFrame:
    lists = _log(spark, d).groupBy("job_id").agg(F.collect_set("label").alias("labels"))
    return L.replaced(lists.union(lists.limit(1).select(F.lit(-1).cast("long"), F.array().cast("array<string>"))))


@query("j9_merged_labels", "WITH a AS (SELECT user_id AS job_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS l FROM events WHERE value > 50 GROUP BY 1), b AS (SELECT user_id AS job_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS l FROM events WHERE value <= 50 GROUP BY 1) SELECT job_id, coalesce(a.l, b.l) AS labels FROM a FULL JOIN b USING (job_id)")
def j9(spark: SparkSession, d: str) -> DataFrame:
    lists = lambda c: _log(spark, d).filter(f"action = '{c}'").groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
    return L.merged(lists("add"), lists("remove"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


@query("w7_recent_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return X.recent_turns(_messages(spark, d)).select("conv_id", "turn")


SUMMARY_SQL = """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS t FROM conversations),
f AS (SELECT *, CASE WHEN t > 4 THEN 3 * ((t - 5) // 3 + 1) ELSE 0 END AS folded FROM m)
SELECT conv_id, max(folded) AS folded, coalesce(string_agg(CASE role WHEN 'user' THEN 'User asked: ' ELSE 'Assistant: ' END || left(text, 100), chr(10) ORDER BY n) FILTER (n <= folded AND role IN ('user', 'assistant')), '') AS summary FROM f GROUP BY conv_id"""


@query("w8_rolling_summaries", SUMMARY_SQL)
def w8(spark: SparkSession, d: str) -> DataFrame:
    return X.summaries(_messages(spark, d), 2)


@query("w9_mentions", r"""WITH u AS (SELECT page_id % 50 AS conv_id, page_id AS turn, unnest(regexp_extract_all(url, 'https?://[^\s<>"]+')) AS u FROM pages), f AS (SELECT conv_id, u, min(turn) AS t FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC) AS n FROM f) SELECT conv_id, string_agg(u, ' ' ORDER BY t) AS urls FROM r WHERE n <= 3 GROUP BY conv_id""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select((F.col("page_id") % 50).alias("conv_id"), F.col("page_id").alias("turn"), F.col("url").alias("text"))
    return X.mentions(rows, 3).withColumn("urls", F.array_join("urls", " "))


@query("v5_memory", SUMMARY_SQL.replace("SELECT conv_id, max(folded)", "SELECT conv_id, (SELECT string_agg(turn::VARCHAR, ',' ORDER BY turn) FROM (SELECT turn FROM conversations c WHERE c.conv_id = f.conv_id ORDER BY turn DESC LIMIT 2)) AS recent, max(folded)"))
def v5(spark: SparkSession, d: str) -> DataFrame:
    return X.memory(_messages(spark, d), 2).select("conv_id", F.array_join(F.transform("recent", lambda r: r["turn"].cast("string")), ",").alias("recent"), "folded", "summary")
