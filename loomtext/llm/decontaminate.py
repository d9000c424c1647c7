"""Benchmark decontamination over a distributed positional inverted index.

Words are runs of digits, a-z (A-Z lower-cased) and bytes from 0x80. A window is ``WINDOW`` consecutive words of a
benchmark item, or a shorter item whole. Three passes over the texts:

1. how often each word of the benchmark occurs in the corpus (added up in tasks, then by word);
2. postings (word, document, positions) of the probe words: the one or two rarest of each window;
3. the texts of the few documents that hold a candidate, for the exact answer.

Between the last two, postings are joined with the items' probes on the word, and a document's lists, adjusted by the
probes' offsets in the item, are intersected: an item is a candidate of a document where all probes of one of its windows
meet. Lists stay lists, however often a word repeats. The third pass looks a document's windows up among those of its
candidates and compares the words, so every match is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import ragged

WINDOW = 13
#: Benchmark words that are sent to every task; a larger benchmark is joined instead.
SENT_WORDS = 500_000
#: Of the bitmap of candidate texts that every task gets: 1 MB, however many there are.
FILTER_BITS = 1 << 23


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    raw, off = C.utf8(texts)
    return C.split_words(C.ALNUM[raw], off)


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in C.steps(b["text"], C.STEP_BYTES // 2):
            part = b.slice(lo, hi - lo)
            flat, begin = words(part["text"])
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), flat.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*part.schema.names[:-1], "words"])


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words) of the items that have words; equal items stay apart."""
    slim = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(C.lean(_word_lists), "item string, words array<string>").filter("size(words) > 0")


def _frequency(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent is None else sent.value
        sums = None if wanted is None else np.zeros(len(wanted), np.int64)
        for b in batches:
            for lo, hi in C.steps(b["text"], C.STEP_BYTES // 2):
                flat, _ = words(b["text"].slice(lo, hi - lo))
                got = pc.value_counts(flat)
                word, n = got.field("values").cast(pa.string()), got.field("counts")
                if wanted is None:
                    yield pa.record_batch({"word": word, "n": n})
                elif len(word):
                    at = pc.index_in(word, wanted)
                    known = at.is_valid().to_numpy(zero_copy_only=False)
                    sums[at.drop_null().to_numpy()] += n.to_numpy()[known]
        if wanted is not None:
            some = np.flatnonzero(sums)
            yield pa.record_batch({"word": wanted.take(pa.array(some)), "n": pa.array(sums[some])})
    return C.lean(run)


def _postings(sent):
    """A row for each document (word null: its number of words) and one for each of its wanted words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent is None else sent.value
        for b in batches:
            for lo, hi in C.steps(b["text"], C.STEP_BYTES // 2):
                part = b.slice(lo, hi - lo)
                flat, begin = words(part["text"])
                n = len(part)
                yield pa.record_batch({"word": pa.nulls(n, pa.string()), "doc_id": part["doc_id"], "key": part["key"], "n_words": pa.array(np.diff(begin)), "positions": pa.nulls(n, pa.list_(pa.int32()))})
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                names = coded.dictionary.cast(pa.string())
                keep = np.flatnonzero(pc.is_in(names, wanted).to_numpy(zero_copy_only=False)[code]) if wanted is not None else np.arange(len(code))
                if not len(keep):
                    continue
                doc = np.searchsorted(begin, keep, "right") - 1
                order = np.lexsort((keep, code[keep], doc))
                keep, doc = keep[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (code[keep][1:] != code[keep][:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keep)).astype(np.int32)), pa.array((keep - begin[doc]).astype(np.int32)))
                of = pa.array(doc[first])
                yield pa.record_batch({"word": names.take(pa.array(code[keep][first])), "doc_id": part["doc_id"].take(of), "key": part["key"].take(of), "n_words": pa.nulls(len(first), pa.int64()), "positions": lists})
    return C.lean(run)


_POSTING = "word string, doc_id long, key long, n_words long, positions array<int>"


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_key(text).alias("key"), text.alias("text"))


def _sent(vocabulary: DataFrame, most: int):
    """The words as a broadcast array if there are at most ``most``, else None."""
    if vocabulary.limit(most + 1).count() > most:
        return None
    rows = sorted(r[0] for r in vocabulary.collect())
    return vocabulary.sparkSession.sparkContext.broadcast(pa.array(rows, pa.string()))


def positional_index(docs: DataFrame, vocabulary: DataFrame | None = None, sent_words: int = SENT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (word, doc_id, key, positions) of ``vocabulary`` (word), or of every word, and a row with n_words for each document."""
    slim = _slim(docs, id_col, text_col)
    if vocabulary is None:
        return slim.mapInArrow(_postings(None), _POSTING)
    sent = _sent(vocabulary, sent_words)
    every = slim.mapInArrow(_postings(sent), _POSTING)
    if sent is None:
        every = every.filter("word is null").union(every.filter("word is not null").join(vocabulary, "word", "left_semi").select(every.columns))
    return every


def corpus_frequency(docs: DataFrame, vocabulary: DataFrame, sent_words: int = SENT_WORDS, text_col: str = "text") -> DataFrame:
    """(word, n): occurrences in all texts of the words of ``vocabulary`` that occur."""
    sent = _sent(vocabulary, sent_words)
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_frequency(sent), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums if sent is not None else sums.join(vocabulary, "word", "left_semi")


def probes(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(item_no, word, at): positions in items such that each window which can occur holds its rarest word, and its second one too where that is rare enough to be worth a posting list; ``need``: (item_no, start, ats)."""
    at = items.select("item_no", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).join(frequency, "word", "left")
    size = F.least(F.lit(window), F.col("n"))
    starts = at.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - size + 1), F.least(F.col("at"), F.col("n") - size))))
    rank = F.row_number().over(Window.partitionBy("item_no", "start").orderBy(F.col("freq").asc_nulls_first(), "at"))
    least = F.first("freq").over(Window.partitionBy("item_no", "start").orderBy(F.col("freq").asc_nulls_first(), "at"))
    two = starts.withColumnRenamed("n", "item_size").withColumn("rank", rank).withColumn("least", least).filter("rank <= 2")
    return two.filter("least is not null and (rank = 1 or freq <= 8 * least)").select("item_no", "start", "at", "word")


def _possible(rows: DataFrame, cands: DataFrame) -> DataFrame:
    """``rows`` whose key may be among the candidates' keys; all that are, and few others, so that few texts are shuffled.

    The candidates' keys set bits of a bitmap of fixed size; the fuller it is, the more rows pass in vain.
    """
    bit = F.pmod("key", F.lit(FILTER_BITS))
    words = cands.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for w, bits in words.collect():  # FILTER_BITS / 64 rows at most
        bitmap[w] = bits
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b["key"].to_numpy() % FILTER_BITS
            yield b.filter(pa.array((sent.value[at // 64] >> (at % 64)) & 1 == 1))

    return rows.mapInArrow(C.lean(run), rows.schema)


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : n + k] * (C.mixed(np.array([7919 * (k + 1)], np.uint64))[0] | np.uint64(1))
    return C.mixed(out)


def covered(own: np.ndarray, items: list[np.ndarray], window: int) -> tuple[int, list[int]]:
    """Of a document's and the items' word hashes: the document's words inside occurring windows, and the items that have one."""
    edge, found = np.zeros(len(own) + 1, np.int64), set()
    sizes = np.array([min(window, len(x)) for x in items])
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        want = np.concatenate([items[k] for k in some])
        each = [_windows(items[k], size) for k in some]
        count = np.array([len(x) for x in each])
        first = np.cumsum([len(items[k]) for k in some]) - [len(items[k]) for k in some]
        start = ragged(first, count)
        kinds, sample, of = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        have = _windows(own, size)
        kind = np.minimum(np.searchsorted(kinds, have), len(kinds) - 1)
        at = np.flatnonzero(kinds[kind] == have)
        for k in range(size):  # the words themselves decide
            at = at[own[at + k] == want[start[sample[kind[at]]] + k]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        met = np.zeros(len(kinds), bool)
        met[kind[at]] = True
        found.update(some[np.unique(np.repeat(np.arange(len(some)), count)[met[of]])].tolist())
    return int((np.cumsum(edge)[:-1] > 0).sum()), sorted(found)


def _exact(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in C.steps(b["text"], C.STEP_BYTES // 2):
                part = b.slice(lo, hi - lo)
                flat, begin = words(part["text"])
                have = C.word_hashes(flat)
                n_hit, n_items, sha = [], [], []
                for k, cands in enumerate(part["cands"]):
                    cands = cands.as_py()
                    hits, found = covered(have[begin[k] : begin[k + 1]], [np.frombuffer(c["hashes"], np.uint64) for c in cands], window)
                    names = sorted({cands[i]["item"] for i in found} - {None})
                    n_hit.append(hits)
                    n_items.append(len(names))
                    sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                yield pa.record_batch({"doc_id": part["doc_id"], "key": part["key"], "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(n_items, pa.int64()), "items_sha256": pa.array(sha)})
    return C.lean(run)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [x.as_py() for x in b["words"]]
        yield pa.record_batch({"item_no": b["item_no"], "item": b["item"], "words": b["words"], "hashes": pa.array([C.word_hashes(pa.array(x, pa.string())).tobytes() for x in lists], pa.binary())})


def _aligned(need: Column) -> Column:
    """Whether the lists of a window's probes, each less the probe's offset in the item, have a place in common."""
    def places(probe: Column) -> Column:
        return F.transform(F.element_at("lists", probe["word"]), lambda p: p - probe["at"])

    both = F.arrays_overlap(places(need[0]), places(F.element_at(need, -1)))
    return F.coalesce(F.when(F.size(need) == 1, F.element_at("lists", need[0]["word"]).isNotNull()).otherwise(both), F.lit(False))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: tuple[int, int] = (1, 20), sent_words: int = SENT_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, for each row of ``docs``.

    A word inside any occurrence of a window is hit; n_items counts the item ids with occurring windows (a null id
    hits, but isn't counted); the hash is over them, sorted as strings, comma-joined. contaminated: n_hit > 0 and
    n_hit / n_words >= ``share``. Null and empty texts have no words and no hits; repeated rows get equal results; an
    empty benchmark hits nothing. ``key`` is a hash of the text.
    """
    C.bounded_batches(docs.sparkSession)
    listed = item_words(items, item_col, item_text_col).withColumn("item_no", F.xxhash64("item", F.array_join("words", " ")))
    bench = C.written(listed.select("item_no", "item", "words").dropDuplicates(["item_no"]).mapInArrow(C.lean(_hashed), "item_no long, item string, words array<string>, hashes binary"))
    vocabulary = C.written(bench.select(F.explode("words").alias("word")).distinct())
    frequency = C.written(corpus_frequency(docs, vocabulary, sent_words, text_col).withColumnRenamed("n", "freq"))
    chosen = C.written(probes(bench, frequency, window))
    index = C.written(positional_index(docs, chosen.select("word").distinct(), sent_words, id_col, text_col))
    posted = index.filter("word is not null").select("word", "doc_id", "key", "positions")
    met = posted.join(chosen.select("item_no", "word").distinct(), "word")
    # a document's lists of an item's probes, each list once; equal rows of a document give equal lists
    lists = met.groupBy("doc_id", "key", "item_no").agg(F.map_from_entries(F.collect_set(F.struct("word", "positions"))).alias("lists"))
    need = chosen.groupBy("item_no", "start").agg(F.sort_array(F.collect_set(F.struct("at", "word"))).alias("need"))
    needs = C.written(need.groupBy("item_no").agg(F.collect_set("need").alias("needs")))
    aligned = lists.join(needs, "item_no").filter(F.exists("needs", _aligned)).select("doc_id", "key", "item_no")
    cands = aligned.join(bench.select("item_no", "item", "hashes"), "item_no").groupBy("doc_id", "key").agg(F.collect_list(F.struct("item", "hashes")).alias("cands"))
    cands = C.written(cands)
    found = C.null_safe(_possible(_slim(docs, id_col, text_col), cands), cands, ["doc_id", "key"], "inner").select("doc_id", "key", "text", "cands")
    found = found.mapInArrow(_exact(window), "doc_id long, key long, n_hit long, n_items long, items_sha256 string").dropDuplicates(["doc_id", "key"])
    sizes = index.filter("word is null").select("doc_id", "key", "n_words")
    out = C.null_safe(sizes, C.written(found), ["doc_id", "key"], "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "key", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((hit > 0) & (share[1] * hit >= share[0] * F.col("n_words"))).alias("contaminated"))


def proximity(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """(doc_id, key, first, second, position, other): occurrences of both words of ``pairs`` at most ``within`` positions apart.

    Positions are joined by blocks of ``within`` + 1, so a very common word does not meet itself across a document.
    """
    posted = index.filter("word is not null").select("word", "doc_id", "key", F.explode("positions").alias("p"))
    step = within + 1
    left = posted.join(pairs.select(F.col("first").alias("word"), "second"), "word").select("doc_id", "key", F.col("word").alias("first"), "second", F.col("p").alias("position"))
    left = left.withColumn("cell", F.explode(F.array(*[(F.col("position") / step).cast("int") + k for k in (-1, 0, 1)])))
    right = posted.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("word").alias("w"), F.col("p").alias("other"), (F.col("p") / step).cast("int").alias("cell"))
    on: Column = left["doc_id"].eqNullSafe(right["d"]) & (left["key"] == right["k"]) & (left["second"] == right["w"]) & (left["cell"] == right["cell"])
    return left.join(right, on).filter((F.abs(F.col("position") - F.col("other")) <= within) & ~((F.col("first") == F.col("second")) & (F.col("position") >= F.col("other")))).select("doc_id", "key", "first", "second", "position", "other")
