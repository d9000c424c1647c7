"""Exact top-k search by a bit-sliced index.

The index: blocks of at most ``ROWS`` vectors in order of their ids; for each attribute and each bit of its quantised
value (less the smallest value of all) a bitmap over the block's rows. Blocks are files in the shared folder, mapped
into memory by the tasks that use them, so queries travel to blocks and not the other way round.

A query's integer weights are added up bitmap-wise: every set bit of a weight contributes the attribute's slices at its
own significance (complemented for a negative weight), and full adders over bitmaps reduce each significance to one
slice. From the most significant slice down, rows are certain or possible until k are settled; rows that tie at the
boundary are resolved by id. Each block gives its own k best, with exact scores; those of all blocks are ranked.

Vectors with a component too large for sums of 64 bits are set aside and compared in whole numbers of any length.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .token_files import _put, mapped

ROWS = 1 << 16
PACK = 32
#: Of a quantised component; products and their sums over 2 million attributes stay below 2^63.
LARGEST = 1 << 21


def quantised(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of the rows that take part in the index, shorter ones padded with zeros; which rows those are, and which are set aside."""
    lists = vectors.to_pylist()
    good = np.array([v is not None and all(x is not None for x in v) and bool(np.isfinite(v).all()) for v in lists], bool)
    aside = np.array([g and max(map(abs, v), default=0) * scale > LARGEST for v, g in zip(lists, good, strict=True)], bool)
    good &= ~aside
    dim = max([len(v) for v, g in zip(lists, good, strict=True) if g], default=0)
    out = np.zeros((int(good.sum()), dim), np.int64)
    for k, v in enumerate(v for v, g in zip(lists, good, strict=True) if g):
        out[k, : len(v)] = np.floor(scale * np.asarray(v, np.float64))
    return out, good, aside


def whole_numbers(vector: list[float], scale: int) -> list[int]:
    """floor(scale * x) of finite components, also where the product is beyond a double."""
    return [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in vector]


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """(attributes * bits, words): bit b of attribute d at row d * bits + b, a bit for each row of ``values`` (not negative)."""
    n, dim = values.shape
    words = -(-n // 64)
    flags = np.zeros((dim, bits, words * 64), np.uint8)
    for b in range(bits):
        flags[:, b, :n] = (values.T >> b) & 1
    return np.packbits(flags, axis=2, bitorder="little").view(np.uint64).reshape(dim * bits, words)


def added(index: np.ndarray, bits: int, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of the sum of weight * value over attributes, and what to add to the sum that they spell."""
    columns: list[list[np.ndarray]] = []
    dims = np.flatnonzero(weights)
    size = np.abs(weights[dims])
    flip = np.where(weights[dims] < 0, ~np.uint64(0), np.uint64(0))
    for w in range(int(size.max(initial=0)).bit_length() + bits):
        rows, masks = [], []
        for t in range(max(0, w - bits + 1), min(w, 63) + 1):
            on = np.flatnonzero((size >> t) & 1)
            rows.append(dims[on] * bits + (w - t))
            masks.append(flip[on])
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        columns.append([index[rows] ^ np.concatenate(masks)[:, None]] if len(rows) else [])
    out, w = [], 0
    while w < len(columns):
        stack = np.concatenate(columns[w]) if columns[w] else np.zeros((1, index.shape[1]), np.uint64)
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                one = a ^ b
                carry = (a & b) | (one & c)
                stack = np.concatenate((one ^ c, stack[3 * third :]))
            else:
                carry = stack[:1] & stack[1:]
                stack = stack[:1] ^ stack[1:]
            if w + 1 == len(columns):
                columns.append([])
            columns[w + 1].append(carry)
        out.append(stack[0])
        w += 1
    return out, -int(size[weights[dims] < 0].sum()) * ((1 << bits) - 1)


def best(total: list[np.ndarray], possible: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest sums among ``possible`` rows; among equal ones at the boundary the first positions."""
    certain = np.zeros_like(possible)
    sure = 0
    for s in reversed(total):
        on = possible & s
        n = int(np.bitwise_count(on).sum())
        if sure + n >= k:
            possible = on
        else:
            certain |= on
            sure += n
            possible = possible & ~s
    spread = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate((spread(certain), spread(possible)[: k - sure]))


def _build(folder: str, scale: int, low: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held_ids, held, rows = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, rows
            ids, dim = np.concatenate(held_ids), max(v.shape[1] for v in held)
            values = np.concatenate([np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for v in held])
            order = np.argsort(ids, kind="stable")
            name = f"block-{part:06d}-{made:04d}"
            _put(folder, f"{name}.ids", iter([ids[order].tobytes()]))
            _put(folder, f"{name}.bits", iter([slices(values[order] - low, bits).tobytes()]))
            yield pa.record_batch({"block": pa.array([name]), "n_rows": pa.array([len(ids)], pa.int64()), "dims": pa.array([dim], pa.int64())})
            held_ids.clear(), held.clear()
            made, rows = made + 1, 0

        for b in batches:
            for at in range(0, len(b), 4096):
                x = b.slice(at, 4096)
                values, good, _ = quantised(x["embedding"], scale)
                if len(values):
                    held_ids.append(x["vec_id"].to_numpy()[good])
                    held.append(values)
                    rows += len(values)
                if rows >= ROWS - 4096:
                    yield from flush()
        if rows:
            yield from flush()
    return run


def _packs(folder: str, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, len(b), PACK):
                x = b.slice(at, PACK)
                values, good, _ = quantised(x["embedding"], scale)
                if len(values):
                    name = f"pack-{part:06d}-{made:04d}"
                    _put(folder, f"{name}.ids", iter([x["vec_id"].to_numpy()[good].tobytes()]))
                    _put(folder, f"{name}.weights", iter([values.tobytes()]))
                    yield pa.record_batch({"pack": pa.array([name])})
                    made += 1
    return run


def _extent(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = n = 0
        for b in batches:
            for at in range(0, len(b), 4096):
                values, _, aside = quantised(b["embedding"].slice(at, 4096), scale)
                low, high, n = min(low, int(values.min(initial=0))), max(high, int(values.max(initial=0))), n + int(aside.sum())
        yield pa.record_batch({"low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()), "aside": pa.array([n], pa.int64())})
    return run


def _gathered(scale: int, aside: bool, rows: int):
    """Rows of up to ``rows`` vectors each: those set aside, or those that are not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, len(b), rows):
                x = b.slice(at, rows)
                _, good, large = quantised(x["embedding"], scale)
                some = x.filter(pa.array(large if aside else good))
                if len(some):
                    vectors = [[float(y) for y in v] for v in some["embedding"].to_pylist()]
                    yield pa.record_batch([pa.array([(part << 32) + made], pa.int64()), pa.array([some["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], ["no", "ids", "vectors"])
                    made += 1
    return run


def _exact(scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 << 63) - 1
        for b in batches:
            for r in b.to_pylist():
                rows = [(i, whole_numbers(v, scale)) for i, v in zip(r["ids"], r["vectors"], strict=True)]
                for q, v in zip(r["asked_ids"], r["asked"], strict=True):
                    w = whole_numbers(v, scale)
                    top = heapq.nsmallest(k, ((-sum(x * y for x, y in zip(w, o, strict=False)), i) for i, o in rows if i != q))
                    yield pa.record_batch({"query_id": pa.array([q] * len(top), pa.int64()), "vec_id": pa.array([i for _, i in top], pa.int64()), "score": pa.array([max(-most - 1, min(most, -s)) for s, _ in top], pa.int64())})
    return run


def _search(folder: str, low: int, bits: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ""
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != held:  # rows come by block
                    held = r["block"]
                    ids = np.asarray(mapped(folder, f"{held}.ids", "<i8"))
                    index = np.asarray(mapped(folder, f"{held}.bits", "<u8")).reshape(r["dims"] * bits, -(-len(ids) // 64))
                every = np.packbits(np.arange(index.shape[1] * 64) < len(ids), bitorder="little").view(np.uint64)
                asked = np.asarray(mapped(folder, f"{r['pack']}.ids", "<i8"))
                flat = np.asarray(mapped(folder, f"{r['pack']}.weights", "<i8"))
                weights = flat.reshape(len(asked), len(flat) // len(asked))
                out: list[list[np.ndarray]] = [[], [], []]
                for q, w in zip(asked, weights, strict=True):
                    short = w[: r["dims"]] if len(w) >= r["dims"] else np.pad(w, (0, r["dims"] - len(w)))
                    total, more = added(index, bits, short)
                    rest = every
                    own = slice(np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right"))
                    if own.start < own.stop:
                        rest = every.copy()
                        for p in range(own.start, own.stop):
                            rest[p // 64] &= ~(np.uint64(1) << np.uint64(p % 64))
                    at = best(total, rest, k)
                    score = np.zeros(len(at), np.int64)
                    for bit, s in enumerate(total):
                        score += ((s[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << bit
                    for x, y in zip(out, (np.full(len(at), q), ids[at], score + more + low * int(short.sum())), strict=True):
                        x.append(y)
                query, vec, score = (np.concatenate(x) for x in out)
                yield pa.record_batch({"query_id": pa.array(query), "vec_id": pa.array(vec), "score": pa.array(score)})
    return run


def _met(packs: DataFrame, blocks: DataFrame, shards: int) -> DataFrame:
    """Every pack with every block (a row for PACK queries, for many vectors): packs go to every shard that has blocks."""
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64(blocks.columns[0]), F.lit(shards)))
    spread = packs.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).join(dealt.select("shard").distinct(), "shard", "left_semi")
    return spread.join(dealt, "shard").drop("shard")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``vectors`` of other ids with the highest
    integer inner product of components floor(scale * x); ties to the smaller id; fewer if there are fewer.

    Rows whose id or vector is null, or whose vector holds null or non-finite components, take no part. A shorter
    vector counts as padded with zeros, an empty one has zeros only. Vectors with a component beyond ``LARGEST`` /
    ``scale`` are compared outside the index; a score beyond 64 bits is the largest or smallest of them. Rows that
    repeat an id are candidates each; a repeated query id is answered once, for its smallest vector.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter("vec_id is not null and embedding is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter("vec_id is not null and embedding is not null")
    asked = C.written(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    ends = [df.mapInArrow(_extent(scale), "low long, high long, aside long").agg(F.min("low"), F.max("high"), F.sum("aside")).first() for df in (slim, asked)]
    low, high = ends[0][0] or 0, ends[0][1] or 0
    bits = max(1, (high - low).bit_length())
    folder = f"{C.shared_folder(spark)}/slices/{uuid.uuid4().hex}"
    index = C.written(slim.mapInArrow(_build(folder, scale, low, bits), "block string, n_rows long, dims long"))
    packs = C.written(asked.mapInArrow(_packs(folder, scale), "pack string"))
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = _met(packs, index.select("block", "dims"), shards).repartition(shards, "pack", "block").sortWithinPartitions("block", "pack")
    found = C.written(spread.mapInArrow(_search(folder, low, bits, k), "query_id long, vec_id long, score long"))
    kind = "no long, ids array<long>, vectors array<array<double>>"

    def exact(asked_aside: bool | None, rows_aside: bool) -> DataFrame:
        """Outside the index: queries set aside, others or both (None), against vectors set aside or others."""
        kinds = (True, False) if asked_aside is None else (asked_aside,)
        sides = [asked.mapInArrow(_gathered(scale, x, PACK), kind) for x in kinds]
        some = C.written((sides[0].union(sides[1]) if len(sides) == 2 else sides[0]).select(F.col("ids").alias("asked_ids"), F.col("vectors").alias("asked")))
        rows = C.written(slim.mapInArrow(_gathered(scale, rows_aside, 256), kind))
        return C.written(_met(some, rows, shards).repartition(shards, "no", "asked_ids").mapInArrow(_exact(scale, k), "query_id long, vec_id long, score long"))

    if ends[0][2]:
        found = found.union(exact(None, True))
    if ends[1][2]:
        found = found.union(exact(True, False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
