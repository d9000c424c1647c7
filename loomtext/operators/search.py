"""Search for whole tables of queries: BM25 postings, exact vectors, hybrid scoring, boolean search, result shaping.

Every operator takes queries as a table and joins; nothing loops over queries or documents. Scores are rounded before
ranking and ties go to the smaller id, so results don't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..functions import predicates as P
from ..functions import text as T
from .store import written

# The usual BM25 parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 9


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf)."""
    return chunks.select(key, F.explode(T.search_tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def document_lengths(chunks: DataFrame, key: str, text: str) -> DataFrame:
    return chunks.select(key, F.size(T.search_tokens(F.col(text))).cast("long").alias("dl"))


def idf(df: DataFrame, n: Column) -> DataFrame:
    """(term, df, idf) of (term, df): log odds of the document frequency among n; negative ones become EPSILON times the mean over all terms."""
    raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((EPSILON * F.avg("raw")).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def term_statistics(posted: DataFrame, lengths: DataFrame) -> DataFrame:
    """(term, df, idf), from a row for each chunk and term."""
    n = lengths.agg(F.count("*").alias("n"))
    return idf(posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)), F.col("n"))


def bm25(queries: DataFrame, chunks: DataFrame, key: str, text: str, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query_id, key, bm25) of all chunks that hold a term of the query; repeated query terms add up."""
    tokens = chunks.select(key, T.search_tokens(F.col(text)).alias("_t"))
    lengths = tokens.select(key, F.size("_t").cast("long").alias("dl"))
    asked = queries.select(query_id, F.explode(T.search_tokens(F.col(query_text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    average = F.broadcast(lengths.agg(F.avg("dl").alias("avgdl")))
    # document frequencies need each term of a chunk once, term frequencies the asked terms only: no posting is shuffled by chunk
    stats = term_statistics(tokens.select(F.explode(F.array_distinct("_t")).alias("term")), lengths)
    every = tokens.select(key, F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("term"))
    posted = every.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    met = asked.join(stats, "term").join(posted, "term").crossJoin(average)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy(query_id, key).agg(F.sum(part).alias("bm25"))


def best(scored: DataFrame, query_id: str, key: str, score: str, k: int, digits: int = DIGITS) -> DataFrame:
    """The k best of each query with their rank, by the rounded score and then the key."""
    s = scored.withColumn(score, F.round(score, digits))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(score), key))).filter(F.col("rank") <= k)


#: Bytes of query vectors that a scan of the rows carries along.
QUERIES_SENT = 32 << 20


def _matrix(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dims`` finite components as a matrix, and which rows those are."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = vectors.filter(fits).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
    good = np.isfinite(x).all(1)
    return x[good], at[good]


def _kept(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the k highest, ties to smaller keys, in no order."""
    if score.shape[1] <= k:
        return score, keys
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    out, names = np.take_along_axis(score, at, 1), np.take_along_axis(keys, at, 1)
    edge = out.min(1)
    for r in np.flatnonzero((score >= edge[:, None]).sum(1) > k):  # more rows than k reach the k-th score
        high = np.flatnonzero(score[r] > edge[r])
        tied = np.flatnonzero(score[r] == edge[r])
        tied = tied[np.argsort(keys[r][tied], kind="stable")][: k - len(high)]
        some = np.concatenate((high, tied))
        out[r], names[r] = score[r][some], keys[r][some]
    return out, names


def _nearest(sent, k: int, dims: int, key: StructField, query: StructField, other_only: bool):
    ids, asked = sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = ids.value, asked.value
        score, keys = np.empty((len(q), 0)), None
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.slice(lo, 4096)
                x, at = _matrix(part["_v"], dims)
                if not len(x):
                    continue
                names = part[key.name].to_numpy(zero_copy_only=False)[at]
                now = np.round(q @ x.T, DIGITS) + 0.0
                if other_only:
                    now[own[:, None] == names[None, :]] = -np.inf
                held = np.broadcast_to(names, now.shape)
                keys = held if keys is None else np.concatenate((keys, held), 1)
                score, keys = _kept(np.concatenate((score, now), 1), keys, k)
        if keys is not None:
            row, col = np.nonzero(score > -np.inf)
            yield pa.record_batch([pa.array(own[row], to_arrow_type(query.dataType)), pa.array(keys[row, col], to_arrow_type(key.dataType)), pa.array(score[row, col])], [query.name, key.name, "score"])
    return run


def _query_blocks(queries: DataFrame, columns: list[str], query_vector: str) -> tuple[Iterator[tuple[pd.DataFrame, np.ndarray]], int]:
    """Blocks of about ``QUERIES_SENT`` bytes of the queries that take part (their ``columns``, their vectors), and the vectors' length."""
    asked = written(queries.select(*columns, F.col(query_vector).cast("array<double>").alias("_q")).filter("_q is not null"))
    dims, n = asked.agg(F.max(F.size("_q")), F.count("*")).first()
    parts = max(1, -(-(n * (dims or 0) * 8) // QUERIES_SENT))

    def blocks() -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for part in range(parts if n else 0):
            own = asked.filter(F.pmod(F.xxhash64(columns[0]), F.lit(parts)) == part).toPandas()
            x, at = _matrix(pa.array(own["_q"].tolist(), pa.list_(pa.float64())), dims)
            if len(x):
                yield own.iloc[at], x

    return blocks(), dims or 0


def nearest(queries: DataFrame, vectors: DataFrame, query_id: str, query_vector: str, key: str, vector: str, k: int, other_only: bool = False) -> DataFrame:
    """(query_id, key, score, rank): for each query the k rows with the highest inner product, rounded to DIGITS; ties to the smaller key.

    Blocks of rows are multiplied with blocks of queries as matrices; a task keeps k rows for each query, and those of
    all tasks are ranked. Queries go to the tasks in blocks of ``QUERIES_SENT`` bytes, each a scan of the rows. Vectors
    that are null, hold null or non-finite components or have another length than the longest query take no part.
    ``other_only``: a row whose key equals the query's id isn't its answer.
    """
    spark = vectors.sparkSession
    fields = StructField(query_id, queries.schema[query_id].dataType), StructField(key, vectors.schema[key].dataType)
    kind = StructType([*fields, StructField("score", DoubleType())])
    rows, out = vectors.select(key, F.col(vector).alias("_v")).filter("_v is not null"), spark.createDataFrame([], kind)
    blocks, dims = _query_blocks(queries, [query_id], query_vector)
    for own, x in blocks:
        sent = spark.sparkContext.broadcast(own[query_id].to_numpy()), spark.sparkContext.broadcast(x)
        out = out.union(rows.mapInArrow(_nearest(sent, k, dims, fields[1], fields[0], other_only), kind))
    return best(out, query_id, key, "score", k)


def _nearest_groups(ids, groups, asked, k: int, dims: int, kind: StructType):
    types = [to_arrow_type(f.dataType) for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, name, _, key, _ = kind.names
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.slice(lo, 4096)
                x, at = _matrix(part["_v"], dims)
                if not len(x):
                    continue
                some = pd.DataFrame({"g": part[name].to_numpy(zero_copy_only=False)[at], "key": part[key].to_numpy(zero_copy_only=False)[at]})
                some["no"] = pd.factorize(some["g"], use_na_sentinel=False)[0]
                some = some.sort_values(["no", "key"])
                now = np.round(asked.value @ x[some.index].T, DIGITS) + 0.0
                edge = np.append(np.flatnonzero(some["no"].diff().fillna(1)), len(some))
                # of equal scores of a group the first has the smallest key
                first = np.stack([a + now[:, a:z].argmax(1) for a, z in zip(edge[:-1], edge[1:], strict=True)], 1)
                score = np.take_along_axis(now, first, 1)
                own, names = groups.value, some["g"].to_numpy()[edge[:-1]]
                same = (own[:, None] == names[None, :]) | (pd.isna(own)[:, None] & pd.isna(names)[None, :])
                score[same] = -np.inf
                score, first = _kept(score, np.argsort(np.argsort(some["key"].to_numpy(), kind="stable"))[first], k)
                back = np.argsort(some["key"].to_numpy(), kind="stable")
                row, col = np.nonzero(score > -np.inf)
                place = back[first[row, col]]
                yield pa.record_batch([pa.array(v, t, from_pandas=True) for v, t in zip((ids.value[row], some["g"].to_numpy()[place], own[row], some["key"].to_numpy()[place], score[row, col]), types, strict=True)], kind.names)
    return run


def nearest_groups(queries: DataFrame, vectors: DataFrame, query_id: str, query_vector: str, key: str, vector: str, group: str, own_group: str, k: int) -> DataFrame:
    """(query_id, group, key, score, rank): for each query the k groups with the best rows, by these rows, as ``nearest`` ranks them.

    The query's ``own_group`` isn't its answer. Of a block of rows the k best groups are enough for each query: a group
    that k others of the block surpass isn't among the k best of all.
    """
    spark = vectors.sparkSession
    kinds = queries.schema[query_id].dataType, vectors.schema[group].dataType, queries.schema[own_group].dataType, vectors.schema[key].dataType, DoubleType()
    kind = StructType([StructField(n, t) for n, t in zip((query_id, group, "_own", key, "score"), kinds, strict=True)])
    rows, out = vectors.select(key, group, F.col(vector).alias("_v")).filter("_v is not null"), spark.createDataFrame([], kind)
    blocks, dims = _query_blocks(queries, [query_id, own_group], query_vector)
    for own, x in blocks:
        sent = [spark.sparkContext.broadcast(v) for v in (own[query_id].to_numpy(), own[own_group].to_numpy(), x)]
        out = out.union(rows.mapInArrow(_nearest_groups(*sent, k, dims, kind), kind))
    one = first_per(out.drop("_own"), [query_id, group], [F.desc("score"), key])
    return best(one, query_id, key, "score", k)


def hashed_vectors(docs: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """(key, embedding): unit vectors of hashed token counts, for corpora without a model's vectors."""
    counts = postings(docs, key, text).withColumn("d", F.pmod(F.xxhash64("term"), F.lit(dims)).cast("int")).groupBy(key, "d").agg(F.sum("tf").alias("w"))
    rows = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", F.col("w").cast("double").alias("w")))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)) / F.col("norm")).alias("embedding"))


def hybrid(vector_top: DataFrame, keyword_top: DataFrame, query_id: str, key: str, alpha: float = 0.55, k: int = 8) -> DataFrame:
    """alpha * vector + (1 - alpha) * BM25 / (its largest + 1e-6) over the candidates of either side: (query_id, key, score)."""
    both = vector_top.select(query_id, key, "score").join(keyword_top.select(query_id, key, "bm25"), [query_id, key], "full")
    most = F.max(F.coalesce("bm25", F.lit(0.0))).over(Window.partitionBy(query_id))
    b = F.coalesce("bm25", F.lit(0.0))
    scaled = F.when(most > 0, b / (most + 1e-6)).otherwise(b)
    return best(both.select(query_id, key, (alpha * F.coalesce("score", F.lit(0.0)) + (1 - alpha) * scaled).alias("score")), query_id, key, "score", k)


def condition(where: Column | Callable[[dict], bool], columns: list[str]) -> Column:
    """A caller's row predicate: a column as it is, a function of a row's ``columns`` (a dict) in Arrow batches."""
    if isinstance(where, Column):
        return where

    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(where(r)) for r in rows.to_dict("records")], dtype="bool")

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, BooleanType())(F.struct(*columns))


def filtered(scored: DataFrame, keep: Column, query_id: str, key: str, score: str, k: int, mode: str = "pre", oversample: int = 120) -> DataFrame:
    """``pre``: the k best rows that meet ``keep``; ``post``: those of the max(k, oversample) best that do, k at most."""
    if mode == "pre":
        return best(scored.filter(keep), query_id, key, score, k)
    wide = best(scored, query_id, key, score, max(k, oversample)).filter(keep)
    return wide.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("rank"))).filter(F.col("rank") <= k)


def first_per(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_n = 1").drop("_n")


def best_per_job(ranked: DataFrame, query_id: str, job: str, k: int) -> DataFrame:
    """The best row (by ``rank``) of each job for each query, the first k of them ranked anew."""
    one = first_per(ranked, [query_id, job], ["rank"])
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("rank"))).filter(F.col("rank") <= k)


def merged_by_content(rows: DataFrame, content: str, position: str, queries: str) -> DataFrame:
    """One row for each content, the first, with the distinct queries that met it."""
    whole = F.struct(*rows.columns)
    one = rows.groupBy(content).agg(F.min_by(whole, position).alias("r"), F.sort_array(F.collect_set(queries)).alias("matched_queries"))
    return one.select("r.*", "matched_queries").drop(queries)


def within_budget(rows: DataFrame, group: str, order: str, cost: Column, budget: int, keep_first: bool = False) -> DataFrame:
    """Rows in order while the running cost is within the budget; the first one always, if so wished."""
    w = Window.partitionBy(group).orderBy(order)
    spent = rows.withColumn("_cost", cost).withColumn("running_cost", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = F.col("running_cost") <= budget
    if keep_first:
        spent = spent.withColumn("_n", F.row_number().over(w))
        keep |= F.col("_n") == 1
    return spent.filter(keep).drop("_cost", "_n")


def boolean_search(docs: DataFrame, key: str, query: str, fields: list[str], limit: int | None = None, metadata: Column | None = None, position: str | None = None) -> DataFrame:
    """(key, snippet): documents whose chosen fields meet a boolean query, in corpus order; the first ``limit`` of them."""
    hay = F.concat_ws(" \n ", *fields)
    hits = docs.filter(P.boolean_match(hay, query))
    if metadata is not None:
        hits = hits.filter(metadata)
    out = hits.orderBy(position or key)
    return (out.limit(limit) if limit else out).select(key, T.snippet(F.col(fields[0]), 200).alias("snippet"))


def best_snippet(chunks: DataFrame, key: str, order: str, text: str, terms: list[str], n: int = 200) -> DataFrame:
    """(key, snippet): the first chunk with any of the terms, else the first chunk."""
    hit = F.min_by(F.col(text), F.when(P.any_term(F.col(text), terms), F.col(order)))
    return chunks.groupBy(key).agg(hit.alias("h"), F.min_by(text, order).alias("f")).select(key, T.snippet(F.coalesce("h", "f"), n).alias("snippet"))


def reranked(candidates: DataFrame, scores: DataFrame | None, query_id: str, key: str, k: int) -> DataFrame:
    """Candidates (query_id, key, rank) in the order of outside scores (query_id, key, relevance); unscored ones follow in rank order."""
    if scores is None:
        return candidates.filter(F.col("rank") <= k)
    met = candidates.join(scores, [query_id, key], "left")
    order = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("relevance"), "rank")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def expanded(seeds: DataFrame, chunks: DataFrame, key: str, position: str, order: str, content: str) -> DataFrame:
    """All chunks of the seeds' jobs, jobs by first appearance, chunks in order, one of each content."""
    jobs = seeds.groupBy(key).agg(F.min(position).alias("job_rank"))
    met = chunks.join(jobs, key)
    return first_per(met, [content], ["job_rank", order])


def citation_lines(rows: DataFrame, group: str, rank: str, title: Column, text: Column) -> DataFrame:
    """(group, answer): numbered snippets, in rank order."""
    line = F.concat(F.lit("["), F.col(rank), F.lit("] "), title, F.lit(": "), T.snippet(text, 300))
    lines = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("line"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("answer"))
