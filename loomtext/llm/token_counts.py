"""Token counts of sections: whole documents are encoded once, and each token's character span is set against sections.

The explicit rule for a token that crosses a boundary: it counts for the section that holds most of its characters, the
earlier one of equals (``majority``); or for the one that holds its first character (``first``); ``split`` counts it by
its share of characters in each. Characters outside every section count for section -1 (nothing is lost).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import Encoder, ragged


def line_sections(texts: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) code points of each line with its line break, over all texts put together, and the text of each.

    Lines longer than ``longest`` characters are cut every ``longest`` ones. Null and empty texts have no line.
    """
    raw, off = C.utf8(texts)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    ends = np.union1d(points[np.flatnonzero(raw == 10) + 1], points[off[1:]])
    ends = ends[ends > 0]
    first = np.concatenate(([0], ends))[:-1]
    # a line break does not count for the length of its line
    broken = np.isin(ends, points[np.flatnonzero(raw == 10) + 1])
    more = np.maximum(ends - first - broken - 1, 0) // longest
    cuts = first.repeat(more) + longest * (ragged(np.zeros(len(more), np.int64), more) + 1)
    ends = np.union1d(ends, cuts)
    sections = np.stack((np.concatenate(([0], ends))[:-1], ends), 1).astype(np.int64)
    return sections, np.searchsorted(points[off[1:]], sections[:, 0], "right")


def listed_sections(lists: list, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``line_sections``, from lists of structs by text, and the number of each in its list."""
    rows = []
    for k, sections in enumerate(lists):
        rows += sorted((k, x["start"], x["end"], j) for j, x in enumerate(sections or []) if x and x["start"] is not None and x["end"] is not None and x["start"] < x["end"])
    got = np.array(rows, np.int64).reshape(-1, 4)
    return got[:, 1:3] + base[got[:, 0]][:, None], got[:, 0], got[:, 3]


def shares(span: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, section, share): what each token counts where; section -1: outside. ``sections``: disjoint, in order."""
    every = np.arange(len(span))
    if not len(sections):
        return every, np.full(len(span), -1), np.ones(len(span))
    stop = np.maximum(span[:, 1], span[:, 0] + 1)
    first = np.searchsorted(sections[:, 1], span[:, 0], "right")  # the first section that ends after the token begins
    last = np.searchsorted(sections[:, 0], stop, "left") - 1  # the last one that begins before it ends
    many = np.maximum(last - first + 1, 0)
    if rule != "split" and (many <= 1).all():
        inside = many == 1 if rule == "majority" else (many == 1) & (sections[np.minimum(first, len(sections) - 1), 0] <= span[:, 0])
        return every, np.where(inside, first, -1), np.ones(len(span))
    token = np.repeat(every, many)
    of = ragged(first, many)
    part = np.minimum(sections[of, 1], stop[token]) - np.maximum(sections[of, 0], span[token, 0])
    if rule == "split":
        whole = np.maximum(span[:, 1] - span[:, 0], 1)
        share, left = part / whole[token], 1 - np.bincount(token, part / whole[token], len(span))
        rest = np.flatnonzero(left > 1e-12)
        return np.concatenate([token, rest]), np.concatenate([of, np.full(len(rest), -1)]), np.concatenate([share, left[rest]])
    out = np.full(len(span), -1)
    if rule == "first":
        holds = sections[of, 0] <= span[token, 0]
        out[token[holds]] = of[holds]
    else:
        order = np.lexsort((of, -part, token))
        lead = order[np.concatenate(([True], token[order][1:] != token[order][:-1]))] if len(order) else order
        out[token[lead]] = of[lead]
    return every, out, np.ones(len(span))


def _count(tokenizer: str, rule: str, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(tokenizer, spans=True)
        for b in batches:
            for lo, hi in C.steps(b["text"]):
                part = b.slice(lo, hi - lo)
                _, span, off = enc.encode_spans(part["text"])
                size = pc.fill_null(pc.utf8_length(part["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                base = np.cumsum(size) - size
                of = np.repeat(np.arange(len(part)), np.diff(off))
                if "sections" in part.schema.names:
                    sections, text, order = listed_sections(part["sections"].to_pylist(), base)
                else:
                    sections, text = line_sections(part["text"], longest)
                    order = np.arange(len(text)) - np.searchsorted(text, text, "left")
                inside = np.clip(sections, base[text][:, None], np.append(base, size.sum())[text + 1][:, None])  # as far as the text goes
                token, at, share = shares(span + base[of][:, None], inside, rule)
                held = at >= 0
                sums = np.bincount(at[held], share[held], len(sections))
                lost = np.bincount(of[token[~held]], share[~held], len(part))
                out = np.flatnonzero(lost > 1e-9)
                none = np.zeros(len(out), np.int64)
                yield pa.record_batch({
                    "doc_id": part["doc_id"].take(pa.array(np.concatenate((text, out)))),
                    "section": pa.array(np.concatenate((order, none - 1))),
                    "start": pa.array(np.concatenate((sections[:, 0] - base[text], none))),
                    "end": pa.array(np.concatenate((sections[:, 1] - base[text], none))),
                    "n_tokens": pa.array(np.concatenate((sums, lost[out])).astype(np.float64)),
                })
    return C.lean(run, keeps=True)


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "majority", sections_col: str | None = None, longest_line: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens): tokens of each section of each document, by ``rule``.

    ``sections_col`` holds an array of structs with start and end (code points, disjoint); without it, the sections are
    the lines, and a line of more than ``longest_line`` characters is several. Every section has a row, empty ones a
    zero; a null or empty text has none. Section -1, where it occurs, holds the tokens outside all sections. Repeated
    rows give repeated results; an empty table gives none.
    """
    if rule not in ("majority", "first", "split"):
        raise ValueError(f"unknown rule: {rule}")
    C.bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(sections_col).alias("sections")] if sections_col else []))
    return slim.mapInArrow(_count(tokenizer, rule, longest_line), "doc_id long, section long, start long, end long, n_tokens double")
