"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

Both token rows of a document are merged like two sorted lists of end offsets. All documents of a step are merged
together: one state vector holds a pointer into A's tokens and one into B's for each of them; a step of the loop emits
the link of every pair of pointers, emits a cut where both tokens end, advances whichever token ends first (both at a
cut), and documents that have ended leave the vector. Long documents enter as several stretches, so no step waits for
one of them. Documents' link counts are summed over the corpus; every batch then fetches the counts of its pairs once.

Encoding: before a single space with a visible character after it both tokenizers begin a token, whatever precedes, so
a distinct piece between two such spaces is encoded once and remembered (tested against whole texts).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import ragged

#: A's tokens in a stretch of a document, about.
STRETCH = 256
#: Pieces that a worker remembers; beyond it, it forgets those that it met in one step only.
REMEMBERED = 300_000

# Fixed value: how byte-level vocabularies split texts before they merge bytes.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary of the tokenizers library: ids of a text, and each id's bytes.

    If ids rise in the order of merges, the ranks are the vocabulary and tiktoken encodes with it, several times as
    fast with equal ids (tested); else the library itself does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        name = byte_names()
        vocabulary = spec["model"]["vocab"]
        self.bytes = {k: bytes(name[c] for c in t) for t, k in vocabulary.items() if all(c in name for c in t)}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        ids = [vocabulary.get(m, -1) for m in merged]
        first = {t for t in vocabulary if len(t) == 1}
        pre = spec.get("pre_tokenizer") or {}
        added = {a["content"] for a in spec.get("added_tokens", [])}
        ranked = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout") and len(first) == 256 and ids == sorted(set(ids)) and min(ids) > max(vocabulary[t] for t in first)
            and set(merged) | first | added >= set(vocabulary)
        )
        self.piecewise = ranked
        if ranked:
            import tiktoken

            ranks = {b: k for k, b in self.bytes.items() if k not in {vocabulary.get(a) for a in added}}
            self.encode = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            self.encode = lambda text: tok.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece vocabulary: ids of a text (it adds the space before), and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        self.bytes = {k: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for k, p in enumerate(names)}
        self.piecewise = not any(re.search("[^▁]▁", p) for p in names)
        self.encode = lambda text: sp.encode(text, num_threads=1)


class Side:
    """One tokenizer in a worker: ids and their number for each remembered piece, lengths of ids in bytes."""

    def __init__(self, tokenizer: ByteLevel | Pieces, leads: bool):
        self.tokenizer, self.leads = tokenizer, leads  # leads: the space before a piece is part of what it is given
        self.length = np.zeros(max(tokenizer.bytes) + 1, np.int64)
        for k, b in tokenizer.bytes.items():
            self.length[k] = len(b)
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def keep(self, slots: np.ndarray, start: np.ndarray) -> None:
        self.ids, self.size = self.ids[ragged(start[slots], self.size[slots])], self.size[slots]

    def text(self, piece: str) -> str:
        return piece if self.leads else piece[1:]

    def one(self, piece: str) -> tuple[list[int], bool]:
        ids = self.tokenizer.encode(self.text(piece))
        return ids, b"".join(self.tokenizer.bytes.get(k, b"") for k in ids) == piece.encode()

    def learn(self, usual: list[str], odd: list[str]) -> np.ndarray:
        """Adds ``usual`` pieces, which may be encoded as one text, then ``odd`` ones; whether each piece's bytes are its tokens'."""
        ids, size, good = [], [], []
        if usual:
            whole = "".join(usual)
            got = np.array(self.tokenizer.encode(self.text(whole)), np.int32)
            stop = np.cumsum(self.length[got])
            bounds = np.cumsum([len(p.encode()) for p in usual])
            at = np.searchsorted(stop, bounds)
            same = b"".join(map(self.tokenizer.bytes.__getitem__, got.tolist())) == whole.encode() and (at < len(stop)).all() and (stop[np.minimum(at, len(stop) - 1)] == bounds).all()
            if same:
                ids.append(got)
                size.append(np.diff(at + 1, prepend=0))
                good.append(np.ones(len(usual), bool))
            else:
                odd = [*usual, *odd]
        if odd:
            each = [self.one(p) for p in odd]
            ids.append(np.array([k for got, _ in each for k in got], np.int32))
            size.append(np.array([len(got) for got, _ in each], np.int64))
            good.append(np.array([same for _, same in each], bool))
        self.ids, self.size = np.concatenate((self.ids, *ids)), np.concatenate((self.size, *size))
        return np.concatenate(good)


class Both:
    """The two tokenizers of a worker, with the pieces that it remembers."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Side(ByteLevel(a), True), Side(Pieces(b), False)
        self.piecewise = self.a.tokenizer.piecewise and self.b.tokenizer.piecewise
        self.names = _numerals(len(self.a.length), b",|"), _numerals(len(self.b.length), b",;")
        self.slot: dict[str, int] = {}
        self.good, self.again = np.zeros(0, bool), np.zeros(0, bool)
        self.starts()

    def starts(self) -> None:
        self.at = [np.cumsum(s.size) - s.size for s in (self.a, self.b)]

    def learn(self, pieces: list[str]) -> None:
        fits = [len(p) > 1 and p[0] == " " and ("!" <= p[1] <= "~" or "\xc0" <= p[1] <= "\xff") and p[-1] != " " for p in pieces]
        usual, odd = ([p for p, f in zip(pieces, fits, strict=True) if f == want] for want in (True, False))
        n = len(self.slot)
        self.slot.update(zip([*usual, *odd], range(n, n + len(pieces)), strict=True))
        good = self.a.learn(usual, odd) & self.b.learn(usual, odd)
        self.good, self.again = np.concatenate((self.good, good)), np.concatenate((self.again, np.zeros(len(good), bool)))
        self.starts()

    def forget(self) -> None:
        keep = np.flatnonzero(self.again)[: REMEMBERED // 2]
        names = list(self.slot)
        for side, start in zip((self.a, self.b), self.at, strict=True):
            side.keep(keep, start)
        self.slot = {names[k]: n for n, k in enumerate(keep.tolist())}
        self.good, self.again = self.good[keep], np.zeros(len(keep), bool)
        self.starts()

    def slots(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new) and len(self.slot) + len(new) > REMEMBERED:
            self.forget()
            at = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
            new = np.flatnonzero(at < 0)
        if len(new):
            self.learn([names[k] for k in new.tolist()])
            at = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts with a space before each text, and the text of each; null and empty texts have none."""
        raw, off = C.utf8(texts)
        full = np.flatnonzero(np.diff(off))
        spaced = np.insert(raw, off[full], 32)
        begin = off[full] + np.arange(len(full))
        first = begin
        if self.piecewise:
            after = spaced[2:]
            cut = (spaced[1:-1] == 32) & (spaced[:-2] != 32) & (((after > 32) & (after < 127)) | (after == 0xC3))
            first = np.union1d(begin, np.flatnonzero(cut) + 1)
        bounds = np.append(first, len(spaced)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(spaced))
        return words, full[np.searchsorted(begin, first, "right") - 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """A's ids, B's ids, both by text, and (text, first token of A, of B) of each stretch; texts whose tokens differ from it have none."""
        words, of = self.pieces(texts)
        slot = self.slots(words) if len(words) else np.zeros(0, np.int64)
        bad = np.bincount(of, ~self.good[slot], len(texts)) > 0
        slot, of = slot[~bad[of]], of[~bad[of]]
        size = self.a.size[slot], self.b.size[slot]
        ids = tuple(s.ids[ragged(start[slot], n)] for s, start, n in zip((self.a, self.b), self.at, size, strict=True))
        before = tuple(np.cumsum(n) - n for n in size)
        new = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
        stretch = (before[0] - np.maximum.accumulate(np.where(new, before[0], 0))) // STRETCH if len(of) else np.zeros(0, np.int64)
        first = np.flatnonzero(new | np.concatenate(([False], stretch[1:] != stretch[:-1]))) if len(of) else np.zeros(0, np.int64)
        return *ids, of[first], before[0][first], before[1][first]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (token of A, token of B), then cuts (last token of A, of B), of stretches that begin at the tokens ``first_*``.

    ``end_*``: byte offsets at which the tokens end, rising over all stretches, which begin and end together.
    """
    stop = np.append(first_a[1:], len(end_a))
    a, b, links, cuts = first_a, first_b, [], []
    if not len(a):
        return (np.zeros(0, np.int64),) * 4
    while len(a):
        links.append((a, b))
        x, y = end_a[a], end_b[b]
        both = x == y
        cuts.append((a[both], b[both]))
        a, b = a + (x <= y), b + (y <= x)
        alive = a < stop
        if not alive.all():
            a, b, stop = a[alive], b[alive], stop[alive]
    return *(np.concatenate(x) for x in zip(*links, strict=True)), *(np.concatenate(x) for x in zip(*cuts, strict=True))


def _numerals(n: int, marks: bytes) -> np.ndarray:
    """Decimal numbers below n with each of ``marks`` after them, as rows of bytes padded with zeros: all for the first mark, then the next."""
    width = len(str(n - 1)) + 1
    return np.frombuffer(b"".join((b"%d%c" % (k, m)).ljust(width, b"\0") for m in marks for k in range(n)), np.uint8).reshape(-1, width)


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all groups as rows of bytes (``a1,a2|b1;...``, zeros to be dropped), and the row at which each of A's tokens stands."""
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[cut_a], last_b[cut_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.concatenate(([0], np.flatnonzero(last_b) + 1))
    at_a = np.arange(len(ids_a)) + ends_b[group_a]
    at_b = np.arange(len(ids_b)) + ends_a[group_b]
    width = max(names[0].shape[1], names[1].shape[1])
    out = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    for at, ids, last, table in ((at_a, ids_a, last_a, names[0]), (at_b, ids_b, last_b, names[1])):
        out[at, : table.shape[1]] = table[ids + last * (len(table) // 2)]
    return out, at_a


_ROWS = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, at array<int>, n array<int>, a array<int>, b array<int>"


def _align(a: str, b: str, digest: bool, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = C.kept(("align", a, b), lambda: Both(a, b))
        for rows in batches:
            if not len(rows):
                continue
            n, texts = len(rows), rows["text"]
            counts = np.zeros((4, n), np.int64)
            groups, every_a, every_b, pairs, owner = [""] * n, [[]] * n, [[]] * n, [], []
            for lo, hi in C.steps(texts):
                ids_a, ids_b, of, first_a, first_b = two.encode(texts.slice(lo, hi - lo))
                link_a, link_b, cut_a, cut_b = lockstep(np.cumsum(two.a.length[ids_a]), np.cumsum(two.b.length[ids_b]), first_a, first_b)
                cut_a, cut_b = np.sort(cut_a), np.sort(cut_b)
                doc_a = np.repeat(of, np.diff(np.append(first_a, len(ids_a)))) + lo
                doc_b = np.repeat(of, np.diff(np.append(first_b, len(ids_b)))) + lo
                for k, docs in enumerate((doc_a, doc_b, doc_a[cut_a], doc_a[link_a])):
                    counts[k] += np.bincount(docs, minlength=n)
                text, at = written_groups(ids_a, ids_b, cut_a, cut_b, two.names)
                begin = np.searchsorted(doc_a, np.arange(lo, hi + 1))
                begin_b = np.searchsorted(doc_b, np.arange(lo, hi + 1))
                for k in np.flatnonzero(np.diff(begin)).tolist():
                    whole = text[begin[k] + begin_b[k] : begin[k + 1] + begin_b[k + 1]].tobytes().translate(None, b"\0")[:-1]
                    groups[lo + k] = hashlib.sha256(whole).hexdigest() if digest else whole.decode()
                    if keep_ids:
                        every_a[lo + k], every_b[lo + k] = ids_a[begin[k] : begin[k + 1]], ids_b[begin_b[k] : begin_b[k + 1]]
                pairs.append(ids_a[link_a].astype(np.int64) << 32 | ids_b[link_b])
                owner.append(doc_a[link_a])
            # each document's distinct pairs, as numbers of the batch's distinct pairs
            number, distinct = pd.factorize(np.concatenate(pairs))
            own, held = pd.factorize(np.concatenate(owner) * max(len(distinct), 1) + number)
            times, order = np.bincount(own, minlength=len(held)), np.argsort(held)
            held, times = held[order], times[order]
            off = np.searchsorted(held, np.arange(n + 1) * max(len(distinct), 1)).astype(np.int32)
            sums = np.bincount(number, minlength=len(distinct))
            batch = uuid.uuid4().int >> 65
            listed = lambda flat: pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))
            ids = lambda lists: pa.array(lists, pa.list_(pa.int32())) if keep_ids else pa.nulls(n, pa.list_(pa.int32()))
            yield pa.record_batch(
                [pa.array([batch] * n, pa.int64()), rows["doc_id"], *map(pa.array, counts), pa.array(groups, pa.string()), listed(held % max(len(distinct), 1)), listed(times), ids(every_a), ids(every_b)],
                ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "n", "a", "b"],
            )
            # and those pairs, in rows without a document's numbers
            one = lambda x: pa.array([x.tolist()], pa.list_(pa.int32()))
            none = [pa.nulls(1, pa.int64())] * 5
            yield pa.record_batch(
                [pa.array([batch], pa.int64()), *none, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), one(sums), one(distinct >> 32), one(distinct & 0xFFFFFFFF)],
                ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "n", "a", "b"],
            )
    return C.lean(run, keeps=True)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    C.bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), a and b (all ids) of each row of ``docs``.

    ``a`` is the file of a byte-level vocabulary of the tokenizers library, which encodes a space and the text; ``b``
    that of a sentencepiece model, which adds the space. A group lies between two byte offsets at which tokens of both
    end. Texts null or empty, or that are not what their tokens spell, have no tokens: zeros, '' and empty arrays.
    Repeated rows give repeated results; an empty table gives none.
    """
    found = _slim(docs, id_col, text_col).mapInArrow(_align(a, b, False, True), _ROWS)
    return found.filter("at is not null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b")


def link_counts(found: DataFrame) -> DataFrame:
    """(a, b, count, best) of the batches' pairs: links that hold them corpus-wide, and whether no other id of A has more with that id of B."""
    pairs = found.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    pairs = C.written(pairs)
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _score(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    k = pairs["k"].to_numpy()
    count[k], best[k] = pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
    at, n = (docs[c].combine_chunks() for c in ("at", "n"))
    size = np.diff(at.offsets.to_numpy())
    at, n, of = at.flatten().to_numpy(), n.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(docs)), size)
    total, leads = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    np.add.at(total, of, n * count[at])
    np.add.at(leads, of, n * best[at])
    out = docs.drop_columns(["batch", "at", "n"])
    return out.append_column("n_best", pa.array(leads)).append_column("count_sum", pa.array(total))


def alignment(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each row of ``docs``; see ``aligned``.

    n_best: links whose pair of ids is, corpus-wide, the most frequent (or one of equals) for its id of B; count_sum:
    the pairs' corpus-wide numbers of links, summed over the document's links. groups_sha256 is '' without tokens.
    A batch's pairs are numbered, so a document carries small numbers, and each batch fetches its pairs' counts once.
    """
    found = C.written(_slim(docs, id_col, text_col).mapInArrow(_align(a, b, True, False), _ROWS))
    own, held = found.filter("at is not null").drop("a", "b"), found.filter("at is null")
    each = held.select("batch", F.posexplode(F.arrays_zip("a", "b"))).select(F.col("batch").alias("lot"), F.col("pos").alias("k"), "col.a", "col.b")
    fetched = each.join(C.written(link_counts(held)), ["a", "b"]).select("lot", "k", "count", "best")
    scored = own.groupBy("batch").cogroup(fetched.groupBy("lot")).applyInArrow(_score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return scored.withColumnRenamed("groups", "groups_sha256")
