"""Encoding whole texts with a public word-level BPE vocabulary, remembering the words already seen.

The vocabulary's own rules drop white space, lower the case and split letters from punctuation, so what stands between
two white spaces, or between an ASCII letter and an ASCII mark other than an apostrophe, is encoded alike wherever it
occurs. A worker therefore encodes a distinct piece once and copies its ids from then on. New pieces of Latin-1 letters
only, the most, are one word each: they go to the model many at a time, and a token that closes a word closes its piece.
The result equals encoding each text whole (tested); texts with ``<|``, which may hold a special token, are encoded
whole, and so is every text if the vocabulary has other rules than these.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

#: Pieces that a worker remembers; beyond it, it forgets those that it met in one step only.
REMEMBERED = 200_000
#: Pieces that the model gets at a time.
TOGETHER = 1000

# The rules of a vocabulary for which pieces may be encoded one by one.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i], start[i] + 1, ... of all rows, one row after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def by_pieces(path: str) -> bool:
    """Whether the vocabulary has the rules for which pieces may be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    rules = (
        t.get("normalizer") == {"type": "Sequence", "normalizers": _NORMALIZER},
        t.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]},
        t.get("truncation") is None, t.get("padding") is None, t.get("post_processor") is None,
        {k: v for k, v in t["model"].items() if k in _MODEL} == _MODEL,
        all(a["content"].startswith("<|") and not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in t["added_tokens"]),
    )
    return all(rules)


class Encoder:
    """A vocabulary in a worker. ``ids`` of remembered pieces lie in one array, with their character spans if wanted."""

    def __init__(self, path: str, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.spans, self.piecewise = Tokenizer.from_file(path), spans, by_pieces(path)
        if self.piecewise:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.marked = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            most = max(vocabulary.values()) + 1
            self.closes, self.length = np.zeros(most, bool), np.zeros(most, np.int64)
            for token, k in vocabulary.items():
                self.closes[k] = token.endswith("</w>")
                self.length[k] = len(token.removesuffix("</w>"))
        self.forget(np.zeros(0, np.int64))

    @classmethod
    def of(cls, path: str, spans: bool = False) -> Encoder:
        return C.kept(("encoder", path, spans), lambda: cls(path, spans))

    def forget(self, keep: np.ndarray) -> None:
        """All pieces but those of the slots ``keep``, in order."""
        if len(keep):
            pick, names = ragged(self.start[keep], self.size[keep]), list(self.slot)
            self.ids, self.size = self.ids[pick], self.size[keep]
            self.span = self.span[pick] if self.spans else self.span
            self.slot = {names[k]: n for n, k in enumerate(keep.tolist())}
        else:
            self.slot: dict[str, int] = {}
            self.size = np.zeros(0, np.int64)
            self.ids, self.span = np.zeros(0, np.uint32), np.zeros((0, 2), np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.again = np.zeros(len(self.size), bool)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, spans and sizes of words of Latin-1 letters."""
        text = [" ".join(words[k : k + TOGETHER]).lower() for k in range(0, len(words), TOGETHER)]
        got = self.model.encode_batch_fast([t if t.isascii() else t.translate(self.marked) for t in text], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        last = np.flatnonzero(self.closes[ids])
        size = np.diff(last, prepend=-1)
        if not self.spans:
            return ids, np.zeros((0, 2), np.int32), size
        raw = np.frombuffer("".join(words).lower().encode(), np.uint8)
        point = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.length[ids])
        first = point[end - self.length[ids]]
        own = np.repeat(first[last - size + 1], size)
        return ids, np.stack((first - own, point[end - 1] + 1 - own), 1).astype(np.int32), size

    def learn(self, pieces: list[str]) -> None:
        letters = [p for p in pieces if p.isalpha()]
        plain = [p for p in letters if p.isascii()]
        if len(plain) < len(letters):
            plain += [p for p in letters if not p.isascii() and max(p) <= "\xff"]
        n = len(self.slot)
        self.slot.update(zip(plain, range(n, n + len(plain)), strict=True))
        parts = [self.words(plain)] if plain else []
        if other := [p for p in pieces if p not in self.slot]:
            got = (self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast)(other, add_special_tokens=False)
            lists = [e.ids for e in got]
            size = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter((i for x in lists for i in x), np.uint32, size.sum())
            span = np.array([o for e in got for o in e.offsets] if self.spans else [], np.int32).reshape(-1, 2)
            parts.append((ids, span, size))
            self.slot.update(zip(other, range(n + len(plain), n + len(pieces)), strict=True))
        self.ids, self.span, self.size = (np.concatenate((old, *new)) for old, new in zip((self.ids, self.span, self.size), zip(*parts, strict=True), strict=True))
        self.start = np.cumsum(self.size) - self.size
        self.again = np.concatenate((self.again, np.zeros(len(self.size) - n, bool)))

    def slots(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        at = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new) and len(self.slot) + len(new) > REMEMBERED:
            self.forget(np.flatnonzero(self.again)[: REMEMBERED // 2])
            at = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
            new = np.flatnonzero(at < 0)
        if len(new):
            names = [pieces[k] for k in new.tolist()]
            self.learn(names)
            at[new] = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    @staticmethod
    def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes with a blank at each cut, where each text begins there, and the cuts (positions before them were inserted)."""
        raw, off = C.utf8(texts)
        low = _LOWER[raw]
        kind = _KIND[low]
        at = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1
        return np.insert(low, at, 32), off + np.searchsorted(at, off, "left"), at

    def whole(self, texts: pa.Array) -> np.ndarray:
        """The rows that are encoded whole."""
        if not self.piecewise:
            return np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
        return np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32 bits), and where each text's begin (one more than texts). Null is empty."""
        odd = self.whole(texts)
        usual = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts) if len(odd) else texts
        data, off, _ = self.pieces(usual)
        words, begin = C.split_words(data, off)
        if len(words):
            slot = self.slots(words)
            size = self.size[slot]
            ids, off = self.ids[ragged(self.start[slot], size)], np.concatenate(([0], np.cumsum(size)))[begin]
        else:
            ids, off = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(odd):
            rows = [ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
            for k in odd:
                rows[k] = np.array(self.tokenizer.encode_batch_fast([texts[int(k)].as_py()], add_special_tokens=False)[0].ids, np.uint32)
            ids, off = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        return ids, off

    def encode_spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, with (first, end) code points of each token in its text between the two; for an encoder with spans."""
        odd = self.whole(texts)
        usual = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts) if len(odd) else texts
        data, off, at = self.pieces(usual)
        words, begin = C.split_words(data, off)
        ids, span, where = np.zeros(0, np.uint32), np.zeros((0, 2), np.int64), np.zeros(len(texts) + 1, np.int64)
        if len(words):
            blank = (data == 32) | ((data >= 9) & (data <= 13))
            first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
            first = np.union1d(first, off[:-1][(off[1:] > off[:-1])][~blank[off[:-1][(off[1:] > off[:-1])]]])
            own = np.ones(len(data), bool)  # bytes that begin a code point of the text itself
            own[at + np.arange(len(at))] = False
            own &= (data & 0xC0) != 0x80
            points = np.concatenate(([0], np.cumsum(own)))
            slot = self.slots(words)
            size = self.size[slot]
            pick = ragged(self.start[slot], size)
            of = np.repeat(np.arange(len(texts)), np.diff(begin))
            shift = points[first] - points[off[:-1]][of]
            ids, span = self.ids[pick], self.span[pick] + np.repeat(shift, size)[:, None]
            where = np.concatenate(([0], np.cumsum(size)))[begin]
        if len(odd):
            rows = [(ids[a:b], span[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]
            for k in odd:
                e = self.tokenizer.encode_batch([texts[int(k)].as_py()], add_special_tokens=False)[0]
                rows[k] = np.array(e.ids, np.uint32), np.array(e.offsets, np.int64).reshape(-1, 2)
            ids, span = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            where = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
        return ids, span, where


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's."""
    return np.insert(ids, off[1:], np.uint32(end_id)), off + np.arange(len(off))
