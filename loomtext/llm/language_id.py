"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) are added up in the tasks that read the texts, then summed by key; the log-probability
matrix, of languages x buckets, is broadcast (its size is checked), and batches of texts are scored by sparse lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 15
ORDERS = (2, 3)
UNKNOWN = "und"
#: Of the broadcast matrix; more languages than fit are an error.
MODEL_MB = 128
#: Text scored or counted at a time, in bytes; an n-gram takes some 60 bytes meanwhile. A longer text is taken in stretches
#: of as many characters.
STEP_BYTES = 1 << 20


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For the code points below 65,536: the lower-case letter, or a blank; and whether it is a letter."""
    fold, letter = np.full(1 << 16, 32, np.uint32), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            fold[c], letter[c] = ord(low[0]), True
    return fold, letter


def grams(texts: pa.Array, buckets: int, orders: tuple[int, ...] = ORDERS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order, the bucket of the n-gram at each place; where each text's places begin; its number of letters.

    Texts are lower-cased and what isn't a letter counts as a blank; there is one before and two behind each text.
    """
    fold, letter = _letters()
    raw, off = C.utf8(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    low = np.minimum(points, 0xFFFF)
    is_letter = letter[low] & (points < 1 << 16)
    seq = np.where(points < 1 << 16, fold[low], points)
    n = len(off) - 1
    seq = np.insert(seq, np.repeat(starts[1:], 2), np.uint32(32))
    first = starts[:-1] + 2 * np.arange(n)
    seq = np.concatenate((np.array([32], np.uint32), seq, np.array([32, 32], np.uint32)))
    size = np.diff(starts) + 1  # n-grams begin with the blank before the text and end with its last character
    begin = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(first - begin[:-1], size) + np.arange(begin[-1])
    out = []
    for order in orders:
        h = np.full(len(seq) - order + 1, 2166136261 + order, np.uint32)
        for k in range(order):
            h ^= seq[k : len(seq) - order + 1 + k]
            h *= np.uint32(16777619)
            h ^= h >> np.uint32(15)
        out.append((h[at] % np.uint32(buckets)).astype(np.int64))
    letters = np.concatenate(([0], np.cumsum(is_letter)))
    return out, begin, np.diff(letters[starts])


def stretches(text: str, buckets: int, size: int) -> Iterator[tuple[list[np.ndarray], int]]:
    """``grams`` and number of letters of a long text, stretch by stretch; each place of the text is in one of them."""
    for at in range(0, len(text), size):
        end = min(at + size, len(text))
        # a stretch sees the characters that its last n-grams reach into; only the first begins with a blank
        found, _, letters = grams(pa.array([text[at : end + max(ORDERS) - 1]]), buckets)
        beyond = sum(x.isalpha() and ord(x) < 1 << 16 for x in text[end : end + max(ORDERS) - 1])
        yield [g[at > 0 : end - at + 1] for g in found], int(letters[0]) - beyond


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lo, hi in C.steps(b["text"], STEP_BYTES):
                text, lang = b["text"].slice(lo, hi - lo), b["lang"].slice(lo, hi - lo).to_pylist()
                if len(text) == 1 and len(text[0].as_py()) > STEP_BYTES:
                    for found, _ in stretches(text[0].as_py(), buckets, STEP_BYTES):
                        for g in found:
                            sums[lang[0]] = sums.get(lang[0], 0) + np.bincount(g, minlength=buckets)
                    continue
                found, begin, _ = grams(text, buckets)
                names = sorted(set(lang))
                of = np.repeat(np.array([names.index(x) for x in lang]), np.diff(begin))
                for g in found:
                    total = np.bincount(of * buckets + g, minlength=len(names) * buckets).reshape(len(names), buckets)
                    for k, name in enumerate(names):
                        sums[name] = sums.get(name, 0) + total[k]
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at].astype(np.int64))})
    return C.lean(run)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and the (buckets, languages) log-probabilities; rows without a language or text are left out."""
    C.bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    sums = C.written(slim.mapInArrow(_count(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in sums.select("lang").distinct().limit(MODEL_MB * (1 << 18) // buckets + 1).collect())
    if len(langs) * buckets * 4 > MODEL_MB << 20:
        raise ValueError(f"more languages than a model of {MODEL_MB} MB holds")
    counts = np.full((buckets, len(langs)), smoothing)
    got = sums.toPandas()
    counts[got["bucket"].to_numpy(), got["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int)] += got["n"].to_numpy()
    return langs, np.log(counts / counts.sum(0)).astype(np.float32) if langs else counts.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score, the posterior probability at equal priors.

    A null text or one without a letter is ``und`` with score 0, as is everything if nothing was learned. Equal
    scores go to the first language by name.
    """
    C.bounded_batches(docs.sparkSession)
    langs, matrix = model
    sent, buckets = docs.sparkSession.sparkContext.broadcast(matrix), len(matrix)
    at = keep.index(text_col) if text_col in keep else len(keep)
    slim = docs.select(*[F.col(f"`{c}`") for c in (keep if text_col in keep else [*keep, text_col])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in C.steps(b.column(at), STEP_BYTES):
                part = b.slice(lo, hi - lo)
                text = part.column(at)
                pred, score = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                if langs:
                    if len(part) == 1 and len(text[0].as_py() or "") > STEP_BYTES:
                        got = [(sum(sent.value[g].sum(0, dtype=np.float64) for g in found), n) for found, n in stretches(text[0].as_py(), buckets, STEP_BYTES)]
                        total, letters = sum(x for x, _ in got)[None, :], np.array([sum(n for _, n in got)])
                    else:
                        found, begin, letters = grams(text, buckets)
                        total = sum(np.add.reduceat(sent.value[g], begin[:-1], axis=0, dtype=np.float64) for g in found)
                    total = np.exp(total - total.max(1, keepdims=True))
                    known = letters > 0
                    for k in np.flatnonzero(~known):  # letters beyond the first 65,536 code points
                        known[k] = any(x.isalpha() for x in text[int(k)].as_py() or "")
                    pred[known] = np.array(langs, object)[total.argmax(1)[known]]
                    score[known] = (total.max(1) / total.sum(1))[known]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(pred.tolist(), pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)])
    return slim.mapInArrow(C.lean(run), f"{kept}, lang_pred string, score double")


def held_out(id_col: Column, part: int = 2, of: int = 4) -> Column:
    """A quarter of the ids, by their CRC; null for a null id."""
    return F.crc32(id_col.cast("string")) % of == part


def identify(docs: DataFrame, keep: list[str], id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``predict`` with a model of the rows that have a language and an id that isn't held out."""
    model = train(docs.filter(~held_out(F.col(id_col))), lang_col, text_col)
    return predict(docs, model, keep, text_col)
