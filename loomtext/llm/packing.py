"""Packing documents into sequences by cutting-stock column generation.

Texts are encoded where they are read. A document of more than a sequence yields whole sequences and a rest; short
documents of one task are bundled first. What remains, the items, is counted by length class (``UNIT`` tokens wide):
that histogram, of a fixed size, is all that reaches the driver. There a linear program over patterns (how many items
of each class a sequence takes) is solved by column generation: the duals of the present basis price a new pattern
through an unbounded-knapsack dynamic program, until Farley's bound shows the basis to be within ``GAP`` of the optimum.
Multiplicities are rounded down, the left-over counts packed first-fit by decreasing length. Items are ranked within
their class (a count for each task and class, prefix sums, and a task-local rank), and rank and pattern give sequence
and place in closed form, so no group of items ever meets in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import Encoder, with_end

UNIT = 8
BUNDLE = 256
GAP = 0.0005

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, cls int, rank long, within long"


def _cut(tokenizer: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), Encoder.of(tokenizer)
        ranks: Counter[int] = Counter()
        bundle: list[tuple] = []
        out: list[tuple] = []

        def item(pieces: list[tuple]) -> None:
            size = sum(p[2] for p in pieces)
            cls = -(-size // UNIT)
            at = 0
            for p in pieces:
                out.append((*p, part, cls, ranks[cls], at))
                at += p[2]
            ranks[cls] += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] * 2
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                out.clear()
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _PIECE.split(", ")])

        for b in batches:
            for lo, hi in C.steps(b["text"], C.STEP_BYTES // 2):
                ids, off = with_end(*enc.encode(b["text"].slice(lo, hi - lo)), end_id)
                for doc, a, z in zip(b["doc_id"].slice(lo, hi - lo).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    for s in range(a, z, limit):
                        e = min(s + limit, z)
                        piece = (doc, s - a, e - s, zlib.crc32(ids[s:e].astype("<u4").tobytes()), z - a)
                        if e - s >= BUNDLE // 2:
                            item([piece])
                            continue
                        bundle.append(piece)
                        if sum(p[2] for p in bundle) >= min(BUNDLE, limit // 2):
                            item(bundle)
                            bundle = []
                yield from flush()
        if bundle:
            item(bundle)
        yield from flush()
    return C.lean(run, keeps=True)


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits; counts by size."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        fits = size <= r
        if fits.any():
            got = np.where(fits, best[r - np.minimum(size, r)] + value, -1.0)
            k = int(got.argmax())
            if got[k] > best[r] + 1e-12:
                best[r], take[r] = got[k], k
    count, r = np.zeros(len(size), np.int64), room
    while r > 0:
        if take[r] < 0:
            r -= 1
        else:
            count[take[r]] += 1
            r -= int(size[take[r]])
    return float(best[room]), count


def patterns(demand: dict[int, int], room: int, gap: float = GAP, most: int = 4000) -> list[tuple[int, dict[int, int]]]:
    """(multiplicity, {size: count}) of patterns that hold exactly ``demand`` items of each size.

    ``most`` bounds the columns that are tried; any basis on the way is feasible, so the bound costs padding only.
    """
    size = np.array(sorted(k for k, n in demand.items() if n), np.int64)
    if not len(size):
        return []
    need = np.array([demand[int(k)] for k in size], float)
    each = room // size
    basis = [np.where(np.arange(len(size)) == i, each[i], 0) for i in range(len(size))]
    inverse = np.diag(1 / each)
    x = need / each
    for _ in range(most):
        dual = inverse.sum(0)
        worth, new = _knapsack(dual, size, room)
        if worth <= 1 + 1e-9 or x.sum() - dual @ need / worth <= gap * x.sum():
            break
        way = inverse @ new
        ratio = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        x -= ratio[out] * way
        x[out] = ratio[out]
        basis[out] = new
    left = need.astype(np.int64)
    made: Counter[tuple] = Counter()
    for n, p in sorted(zip(x, basis, strict=True), key=lambda v: -v[0]):
        used = p > 0
        n = min(int(n + 1e-9), int((left[used] // p[used]).min()))
        if n > 0:
            made[tuple(p)] += n
            left -= n * p
    bins: list[list] = []
    for k in range(len(size) - 1, -1, -1):
        for _ in range(int(left[k])):
            hold = next((b for b in bins if b[0] >= size[k]), None)
            if hold is None:
                bins.append(hold := [room, np.zeros(len(size), np.int64)])
            hold[0] -= size[k]
            hold[1][k] += 1
    made.update(tuple(b[1]) for b in bins)
    return [(n, {int(s): int(c) for s, c in zip(size, p, strict=True) if c}) for p, n in made.items()]


def _places(plan: list[tuple[int, dict[int, int]]]):
    """Arrays by class: the first rank that each pattern takes, its items of the class, its first sequence, its order."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter[int] = Counter()
    base = 0
    for n, p in plan:
        for cls, c in p.items():
            by.setdefault(cls, []).append((taken[cls], c, base))
            taken[cls] += n * c
        base += n
    return {cls: np.array(v, np.int64) for cls, v in by.items()}


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = b["cls"].to_numpy(), b["rank"].to_numpy()
            seq, slot = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for k in np.unique(cls):
                own = np.flatnonzero(cls == k)
                first, each, base = where[int(k)].T
                at = np.searchsorted(first, rank[own], "right") - 1
                over = rank[own] - first[at]
                seq[own], slot[own] = base[at] + over // each[at], over % each[at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot)], [*b.schema.names, "sequence_id", "slot"])
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents and their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id`` (null and empty texts: the end id alone); it is cut only every
    ``limit`` ids. Every id of every row lies in one piece; rows that repeat a doc_id are packed each. Offsets of a
    sequence run from 0 without gaps. An empty table gives no rows. ``limit`` is a multiple of ``UNIT``.
    """
    if limit % UNIT:
        raise ValueError(f"limit must be a multiple of {UNIT}")
    C.bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = C.written(slim.mapInArrow(_cut(tokenizer, end_id, limit), _PIECE))
    counts = C.written(pieces.filter("within = 0").groupBy("part", "cls").agg(F.count("*").alias("n")))
    demand = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # limit / UNIT rows at most
    full = limit // UNIT
    plan = ([(demand.pop(full), {full: 1})] if full in demand else []) + patterns(demand, full)
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = C.written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    ranked = pieces.join(bases, ["part", "cls"]).withColumn("rank", F.col("rank") + F.col("base")).select(*[c.split()[0] for c in _PIECE.split(", ")])
    placed = ranked.mapInArrow(_place(_places(plan)), f"{_PIECE}, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "slot", "within").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0))
    return placed.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
