"""Token files: flat unsigned integers, with 64-bit document offsets beside them.

A part is ``part-NNNNNN.u16`` (or ``.u32`` for vocabularies over 65,536 ids): the ids of its documents, nothing else;
``part-NNNNNN.idx``: signed 64-bit (offset of each document among all ids of all parts, and the end of the last), and
``part-NNNNNN.doc``: the 64-bit doc_ids. Parts follow each other by doc_id. A first pass writes ids and local offsets,
the sums before each part are its base, and a second pass, a task a part, adds it. Files are written under another
name and renamed, so a repeated task leaves a whole file. Readers map the files into memory where the folder is local
or mounted, and read ranges otherwise.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import Encoder, with_end

#: Stands for a null doc_id in a .doc file.
NO_ID = np.iinfo(np.int64).min


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, parts: Iterator[bytes]) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for p in parts:
            out.write(p)
    store.move(own, f"{path}/{name}")


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory if it is local, else read."""
    store, path = _store(folder)
    size = store.get_file_info(f"{path}/{name}").size
    if not size:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", kind, "r")
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(size), kind)


def _size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def _write(folder: str, tokenizer: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), Encoder.of(tokenizer)
        ids, size = [], []

        def pieces() -> Iterator[bytes]:
            for b in batches:
                for lo, hi in C.steps(b["text"]):
                    x, off = with_end(*enc.encode(b["text"].slice(lo, hi - lo)), end_id)
                    ids.append(b["doc_id"].slice(lo, hi - lo).fill_null(NO_ID).to_numpy())
                    size.append(np.diff(off))
                    yield x.astype(kind).tobytes()

        _put(folder, f"part-{part:06d}.{'u16' if kind == '<u2' else 'u32'}", pieces())
        n = np.concatenate(size) if size else np.zeros(0, np.int64)
        _put(folder, f"part-{part:06d}.doc", iter([np.concatenate(ids).astype("<i8").tobytes() if ids else b""]))
        _put(folder, f"part-{part:06d}.loc", iter([np.concatenate(([0], np.cumsum(n))).astype("<i8").tobytes()]))
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(n)], pa.int64()), "n_tokens": pa.array([int(n.sum())], pa.int64())})
    return C.lean(run, keeps=True)


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(b["part"].to_pylist(), b["base"].to_pylist(), strict=True):
                _put(folder, f"part-{part:06d}.idx", iter([(mapped(folder, f"part-{part:06d}.loc", "<i8") + base).astype("<i8").tobytes()]))
            yield b
    return run


def _dealt(parts: DataFrame) -> DataFrame:
    """Parts over as many tasks as a shuffle has; few small rows would otherwise go to one."""
    return parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text's ids and ``end_id``, by doc_id; returns the parts: part, n_docs, n_tokens, base, folder, kind.

    Null and empty texts have the end id alone. Rows of one doc_id follow each other by text; null doc_ids come first.
    An empty table gives parts without documents, or none. The default folder is a new one in ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    folder = folder or f"{C.shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    kind = "<u2" if max(_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    parts = C.written(dealt.mapInArrow(_write(folder, tokenizer, end_id, kind), "part int, n_docs long, n_tokens long"))
    # a row for each part, not for each document
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = _dealt(parts.withColumn("base", before))
    return C.written(based.mapInArrow(_index(folder), "part int, n_docs long, n_tokens long, base long").withColumns({"folder": F.lit(folder), "kind": F.lit(kind)}))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            stem, folder = f"part-{r['part']:06d}", r["folder"]
            ids = mapped(folder, f"{stem}.{'u16' if r['kind'] == '<u2' else 'u32'}", r["kind"])
            off, doc = mapped(folder, f"{stem}.idx", "<i8"), mapped(folder, f"{stem}.doc", "<i8")
            for lo in range(0, len(doc), 5000):
                hi = min(lo + 5000, len(doc))
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(off[lo:hi] - r["base"], off[lo + 1 : hi + 1] - r["base"], strict=True)]
                yield pa.record_batch({
                    "doc_id": pa.array(doc[lo:hi], mask=doc[lo:hi] == NO_ID),
                    "start": pa.array(off[lo:hi]),
                    "n_tokens": pa.array(np.diff(off[lo : hi + 1])),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })


def read_token_files(parts: DataFrame) -> DataFrame:
    """What the files of ``write_token_files`` hold: doc_id, start, n_tokens, ids_crc32 of each document."""
    return _dealt(parts).mapInArrow(C.lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
