"""Helpers that several operators share: written tables in the shared folder and vectorised text handling in tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one vectorised step works on at a time, in bytes; a longer single document makes a step of its own.
STEP_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on one machine, where the session names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


#: Rows and bytes of the Arrow batches that Python workers get, at most.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
#: Rows that the Parquet reader holds as one batch, at most; whole texts of 4,096 rows are large arrays on the heap.
READ_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow and Parquet batches to a size that leaves workers and executors room for the work on them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are sent to every task rather than met in a shuffle, at most.
SENT_ROWS = 400_000


def sent_if_small(marks: DataFrame) -> DataFrame:
    """A written table of ids and flags, marked for broadcast if it has at most ``SENT_ROWS`` rows (some 40 MB).

    Joined to texts, it then saves the shuffle of all texts; a larger one is joined in the shuffle.
    """
    return F.broadcast(marks) if marks.limit(SENT_ROWS + 1).count() <= SENT_ROWS else marks


#: Rows of a few numbers that make a task of their own, at least.
TASK_ROWS = 50_000


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` of at most ``rows`` rows in tasks of some ``each`` rows, one a core at least; never in more than it has.

    However many partitions a shuffle has, a small table then costs few tasks and files; a large one stays as it is.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of iterative steps."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text; joins on (doc_id, key) stay right when rows repeat."""
    return F.xxhash64(text)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """What a worker keeps from task to task: ``make()`` of the last ``key`` only, so a worker that turns to other work forgets."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back(keeps: bool) -> None:
    """Freed memory goes back to the system, and what was kept is freed unless the worker ``keeps`` it."""
    if not keeps:
        _KEPT.clear()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(step, keeps: bool = False):
    """``step`` for a worker that gives memory back after each task, as it idles beside the tasks of other stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back(keeps)
    return run


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys match; the right side's keys are dropped."""
    marked = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        one = left[c].eqNullSafe(marked[f"__r_{c}"])
        cond = one if cond is None else cond & one
    out = left.join(marked, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{c}" for c in on])


#: Bits of a bitmap that every task gets: 1 MB, however many keys set one.
BITMAP_BITS = 1 << 23


def bit(key: Column) -> Column:
    """The place of a 64-bit key in a bitmap."""
    return F.pmod(key, F.lit(BITMAP_BITS))


def bitmap(places: DataFrame):
    """A broadcast bitmap (64-bit words) of the column ``at`` of places; the fuller it is, the less it tells apart.

    It lets tasks drop most rows that a later join would drop, before they are shuffled.
    """
    words = places.groupBy(F.expr("at div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for w, bits in words.collect():  # BITMAP_BITS / 64 rows at most
        out[w] = bits
    return places.sparkSession.sparkContext.broadcast(out)


def is_set(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at // 64] >> (at % 64)) & 1 == 1


# --- text in Arrow batches ------------------------------------------------------------------------------------------

def _table(lower: bool, blank: list[int]) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[blank] = 32
    return t


_SPACES = [9, 10, 11, 12, 13, 32]
LOWER = _table(True, _SPACES)
#: For words of [0-9a-z] and all bytes from 0x80; A-Z counts as lower case.
ALNUM = _table(True, [b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)])


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield at, min(end, n)
        at = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more than rows); null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def split_words(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space: all of them in order, and where each text's words begin (one more than texts)."""
    arr = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    parts = pc.ascii_split_whitespace(arr)
    flat = parts.flatten()
    begin = np.asarray(parts.offsets, dtype=np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        begin = np.concatenate(([0], np.cumsum(full)))[begin]
        flat = flat.filter(pa.array(full))
    return flat, begin


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches as they come, cut to at most ``rows`` rows."""
    for b in batches:
        for at in range(0, max(len(b), 1), rows):
            yield b.slice(at, rows)
