"""Queries of name normalising, answers, tiers and keyword sections. Their entities and answers are built from each document's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import aspects as A
from ..operators import chunking as C
from ..operators.rules import ALIASES, SECTION_NAMES
from .chunk_queries import SOFT_SQL
from .registry import query
from .tables import table


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPELLINGS = [a for a, _ in ALIASES]
_ALIAS_SQL = "rules(no, alias, canonical) AS (VALUES " + ", ".join(f"({no}, {_quoted(a)}, {_quoted(c)})" for no, (a, c) in enumerate(ALIASES)) + "), known AS (SELECT alias, arg_max(canonical, no) AS canonical FROM rules GROUP BY alias)"


def _mention_sql(k: str) -> str:
    return f"[{', '.join(map(_quoted, _SPELLINGS))}][1 + (doc_id + 7 * {k}) % {len(_SPELLINGS)}]"


def _mention(k: int) -> Column:
    """A known spelling, another one for each document and ``k``."""
    at = F.pmod(F.col("doc_id") + 7 * k, F.lit(len(_SPELLINGS))).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, _SPELLINGS)), at)


@query("a11_alias_names", f"WITH {_ALIAS_SQL}, m AS (SELECT doc_id, '  ' || upper({_mention_sql('0')}) || ' ' AS entity FROM documents) SELECT doc_id, entity, coalesce(canonical, trim(entity)) AS canonical FROM m LEFT JOIN known ON lower(trim(entity)) = alias")
def a11(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select("doc_id", F.concat(F.lit("  "), F.upper(_mention(0)), F.lit(" ")).alias("entity"))
    return A.normalised(names, A.aliases(spark), fuzzy=False).select("doc_id", "entity", "canonical")


#: The longest common subsequence's row after each character of a form: the greatest of what stood there and of one more than before any match so far.
_A12 = f"""WITH {_ALIAS_SQL}, m AS (SELECT doc_id, left(s, 2) || substring(s, 2, 100) AS entity FROM (SELECT doc_id, {_mention_sql('0')} AS s FROM documents)),
e AS (SELECT DISTINCT lower(trim(entity)) AS form FROM m WHERE lower(trim(entity)) NOT IN (SELECT alias FROM known)),
p AS (SELECT form, canonical, list_transform(string_split(form, ''), lambda x: [unicode(x)]) AS f, list_transform(string_split(lower(canonical), ''), lambda x: unicode(x)) AS n
  FROM e JOIN (SELECT DISTINCT canonical FROM known) ON 200 * least(len(form), len(canonical)) >= 85 * (len(form) + len(canonical))),
l AS (SELECT form, canonical, list_reduce(f, lambda row, x: list_transform(range(1, len(n) + 1), lambda j:
    greatest(row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda t: n[t] = x[1]), lambda t: coalesce(row[t - 1], 0) + 1)), 0))), list_transform(n, lambda x: 0)) AS row FROM p),
near AS (SELECT form, canonical, 200.0 * list_max(row) / (len(form) + len(canonical)) AS r FROM l),
best AS (SELECT form, canonical AS nearest FROM near WHERE r >= 85 QUALIFY row_number() OVER (PARTITION BY form ORDER BY r DESC, canonical) = 1)
SELECT doc_id, entity, coalesce(canonical, nearest, trim(entity)) AS canonical FROM m LEFT JOIN known ON lower(trim(entity)) = alias LEFT JOIN best ON lower(trim(entity)) = form"""


@query("a12_fuzzy_names", _A12)
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Spellings with their second character twice."""
    once = _mention(0)
    names = table(spark, d, "documents").select("doc_id", F.concat(F.left(once, F.lit(2)), F.substring(once, 2, 100)).alias("entity"))
    return A.normalised(names, A.aliases(spark)).select("doc_id", "entity", "canonical")


@query("a13_name_lists", f"""WITH {_ALIAS_SQL}, m AS (SELECT doc_id, k, {_mention_sql('k')} AS entity FROM documents, unnest(generate_series(0, 8)) AS t(k)),
once AS (SELECT doc_id, lower(canonical) AS l, arg_min(canonical, k) AS canonical, min(k) AS k FROM m JOIN known ON entity = alias GROUP BY doc_id, lower(canonical))
SELECT doc_id, string_agg(canonical, ',' ORDER BY k) AS names FROM once GROUP BY doc_id""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "documents").select("doc_id", F.array(*[_mention(k) for k in range(9)]).alias("names"))
    return A.normalised_lists(lists, A.aliases(spark), "doc_id", "names").select("doc_id", F.array_join("names", ",").alias("names"))


@query("a14_extra_aliases", "SELECT doc_id, 'Source ' || source AS canonical FROM documents")
def a14(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    extra = docs.filter("source is not null").select(F.col("source").alias("alias"), F.concat(F.lit("Source "), "source").alias("canonical")).distinct()
    names = docs.select("doc_id", F.concat(F.lit(" "), F.upper("source")).alias("entity"))
    return A.normalised(names, A.aliases(spark, extra), fuzzy=False).select("doc_id", "canonical")


_ANSWER = """CASE doc_id % 3 WHEN 0 THEN 'As asked:' || chr(10) || '```json' || chr(10) || '{"id": ' || doc_id || ', "lang": "' || lang || '"}' || chr(10) || '```' || chr(10) || 'Done.'
WHEN 1 THEN ' {"id": ' || doc_id || ', "lang": "' || lang || '"} ' ELSE 'No record for ' || doc_id END"""


@query("c15_fenced_records", f"""WITH a AS (SELECT doc_id, {_ANSWER} AS answer FROM documents),
b AS (SELECT doc_id, CASE WHEN regexp_extract(answer, '(?s)```(?:json)?\\s*(.*?)```', 1) <> '' THEN trim(regexp_extract(answer, '(?s)```(?:json)?\\s*(.*?)```', 1)) ELSE trim(answer) END AS body FROM a)
SELECT doc_id, CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.id') AS BIGINT) ELSE -1 END AS id, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.lang') END AS lang FROM b""")
def c15(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "documents").select("doc_id", F.expr(_ANSWER.replace("chr(10)", "char(10)")).alias("answer"))
    return answers.select("doc_id", T.fenced_json(F.col("answer"), "id long, lang string").alias("r")).select("doc_id", F.coalesce("r.id", F.lit(-1)).alias("id"), "r.lang")


_CITING = "'[' || doc_id % 7 || '] ' || text || ' [' || doc_id % 3 || '] [' || doc_id % 7 || ']'"
_CITED_SQL = f"""m AS (SELECT doc_id, doc_id % 5 + 1 AS n, regexp_extract_all({_CITING}, '\\[([0-9]+)\\]', 1) AS m FROM documents),
c AS (SELECT doc_id, CAST(unnest(m) AS BIGINT) AS i, generate_subscripts(m, 1) AS pos FROM m), f AS (SELECT doc_id, i, min(pos) AS pos FROM c GROUP BY doc_id, i)"""


def _citing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.citations(F.expr(_CITING)).alias("i"))


@query("c16_citations", f"WITH {_CITED_SQL} SELECT doc_id, coalesce(s, '') AS citations FROM documents LEFT JOIN (SELECT doc_id, string_agg(i, ',' ORDER BY pos) AS s FROM f GROUP BY doc_id) USING (doc_id)")
def c16(spark: SparkSession, d: str) -> DataFrame:
    return _citing(spark, d).select("doc_id", F.array_join(F.col("i").cast("array<string>"), ",").alias("citations"))


@query("c17_cited_sources", f"""WITH {_CITED_SQL}, met AS (SELECT doc_id, string_agg('s' || i, ',' ORDER BY pos) AS s FROM f JOIN m USING (doc_id) WHERE i BETWEEN 1 AND n GROUP BY doc_id)
SELECT doc_id, coalesce(s, array_to_string(list_transform(generate_series(1, n), lambda x: 's' || x), ',')) AS sources FROM m LEFT JOIN met USING (doc_id)""")
def c17(spark: SparkSession, d: str) -> DataFrame:
    sources = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("s"), i.cast("string")))
    return _citing(spark, d).select("doc_id", F.array_join(T.cited(sources, F.col("i")), ",").alias("sources"))


_BOOLEAN = '("of the" AND ation) OR que NOT und'


@query("f6_highlight_terms", "SELECT CAST(pos AS INTEGER) AS pos, term, count(doc_id) AS n FROM (VALUES (0, 'of the'), (1, 'ation'), (2, 'que'), (3, 'und')) AS t(pos, term) LEFT JOIN documents ON contains(lower(text), term) GROUP BY ALL")
def f6(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each highlight term of a boolean query is."""
    low, terms = F.lower(T.text_or_empty(F.col("text"))), P.search_terms(_BOOLEAN)
    counts = table(spark, d, "documents").agg(*[F.count_if(low.contains(t)).alias(f"n{i}") for i, t in enumerate(terms)])
    each = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("term"), F.col(f"n{i}").alias("n")) for i, t in enumerate(terms)])
    return counts.select(F.inline(each))


_INTENT_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {_quoted(p)})" for p in parts) + f" THEN '{name}'" for name, parts in P.INTENTS) + " ELSE 'search' END"


@query("f16_context_tiers", f"""SELECT doc_id, CAST(CASE WHEN intent = 'search' THEN CASE WHEN jobs > 10 THEN 0 ELSE 1 END WHEN intent = 'explore' THEN 0
WHEN intent = 'compare' THEN CASE WHEN jobs <= 3 THEN 2 ELSE 1 END WHEN intent = 'detail' THEN 3 ELSE 1 END AS INTEGER) AS tier FROM (SELECT doc_id, {_INTENT_SQL} AS intent, doc_id % 20 AS jobs FROM documents)""")
def f16(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", P.intent(F.col("text"))["intent"].alias("intent"))
    return found.select("doc_id", P.context_tier(F.col("intent"), F.col("doc_id") % 20).alias("tier"))


_HEADED = "text || chr(10) || 'Requirements:' || chr(10) || text || chr(10) || 'BENEFITS' || chr(10) || source"

_X2 = f"""WITH names(k, name) AS (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in SECTION_NAMES.items())}),
l AS (SELECT doc_id, {SOFT_SQL} AS l FROM (SELECT doc_id, {_HEADED} AS text FROM documents)),
ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM l),
h AS (SELECT doc_id, line, pos, name FROM ln LEFT JOIN names ON regexp_replace(lower(trim(line)), ':+$', '') = k),
s AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS no FROM h)
SELECT doc_id, max(name) AS name, max(line) FILTER (name IS NOT NULL) AS raw_name, string_agg(line, chr(10) ORDER BY pos) FILTER (name IS NULL) AS text, CAST(min(pos) AS INTEGER) AS start_line, CAST(max(pos) AS INTEGER) AS end_line
FROM s GROUP BY doc_id, no HAVING count(*) FILTER (name IS NULL) > 0"""


@query("x2_keyword_sections", _X2)
def x2(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.expr(_HEADED.replace("chr(10)", "char(10)")).alias("text"))
    return C.sections(docs, "doc_id", "text", "keyword").drop("section_no")
