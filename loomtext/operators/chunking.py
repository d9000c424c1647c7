"""Sections and chunks of documents.

A document's lines, sections, chunks and reassembled text are arrays of its own row; bullets, sentence windows and
overlaps are folds over a block's own lines. So nothing of a text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rules import CONTENT, SECTION_NAMES, SMALL_HEADER

# Formats of bullets and sentence ends, sizes of windows.
BULLET = r"^\s*([\-\*•●◦]|\d+\.)\s+"
STRUCTURE_BULLET = r"^\s*([•\-\*–]\s+|\d+\.\s+)"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
WINDOW, OVERLAP, SHORTEST = 900, 150, 20


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line)."""
    return docs.select(key, F.posexplode(T.soft_lines(F.col(text))).alias("pos", "line"))


def header_score(line: Column, following: Column) -> Column:
    """How much a trimmed line looks like a header; ``following``: an array of the next three lines. A header has 3 or more."""
    def score(words: Column) -> Column:
        n = F.size(words)
        colon, short = line.endswith(":"), n <= 8
        caps = (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) > 3)
        title = (n >= 2) & (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= 0.6 * n)
        bullets = F.exists(following, lambda x: F.coalesce(x.rlike(STRUCTURE_BULLET), F.lit(False)))
        total = F.when(colon & short, 3).otherwise(0) + F.when(caps, 2).otherwise(0) + F.when(title & short, 2).otherwise(0) + F.when(bullets, 2).otherwise(0) + F.when(line.rlike(r"^\d+\.\s+"), 1).otherwise(0)
        return F.when((n < 2) & ~colon, 0).otherwise(total)

    words = T.words(F.regexp_replace(F.regexp_replace(line, ":+$", ""), r"(?U)\s+", " "))
    return F.when((line == "") | (F.length(line) > 60), 0).otherwise(T.bound(words, score))


def header_lines(rows: DataFrame, key: str) -> DataFrame:
    """Lines with their structural score and whether they are a header by it or by a known name."""
    w = Window.partitionBy(key).orderBy("pos")
    nxt = F.array(*[F.lead("line", k).over(w) for k in (1, 2, 3)])
    scored = rows.withColumn("_next", nxt).withColumn("score", header_score(F.trim("line"), F.col("_next"))).drop("_next")
    return scored.withColumn("is_header", (F.col("score") >= 3) | canonical_name(F.col("line")).isNotNull())


def canonical_name(header: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SECTION_NAMES.items() for x in kv])
    return F.try_element_at(names, F.regexp_replace(F.lower(F.trim(header)), ":+$", ""))


def name_by_content(header: Column, content: Column) -> Column:
    """The known name of a header, else the first kind whose pattern the content meets, else the header as a slug."""
    def by_text(low: Column) -> Column:
        return F.coalesce(*[F.when(low.rlike(pattern), F.lit(name)) for pattern, name in CONTENT])

    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(header)), ":+$", ""), "[^a-z0-9]+", "_"), 1, 30)
    return F.coalesce(canonical_name(header), T.bound(F.lower(content), by_text), F.when(slug != "", slug), F.lit("other"))


def _is_header(line: Column, following: Column, mode: str) -> Column:
    if mode == "small":
        return line.rlike(SMALL_HEADER)
    known = canonical_name(line).isNotNull()
    return known if mode == "keyword" else known | (T.bound(F.trim(line), lambda x: header_score(x, following)) >= 3)


def section_list(text: Column, mode: str = "small") -> Column:
    """A document's sections with text, in order: an array of (section_no, name, raw_name, text, start_line, end_line)."""
    def name(raw: Column, body: Column) -> Column:
        return F.lower(F.trim(raw)) if mode == "small" else canonical_name(raw) if mode == "keyword" else F.when(raw.isNotNull(), name_by_content(raw, body))

    def cut(found: Column, heads: Column) -> Column:
        def one(j: Column) -> Column:
            # a section but the first begins with its header
            begin, bare = F.when(j > 0, F.get(heads, j - 1)).otherwise(0), F.when(j > 0, 1).otherwise(0)
            end = F.when(j < F.size(heads), F.get(heads, j)).otherwise(F.size(found))
            body = F.array_join(F.slice(found, begin + bare + 1, end - begin - bare), "\n")
            return F.struct(j.cast("long").alias("section_no"), F.when(j > 0, F.get(found, begin)).alias("raw_name"), body.alias("text"), begin.alias("start_line"), (end - 1).alias("end_line"))

        some = F.filter(F.transform(F.sequence(F.lit(0), F.size(heads)), one), lambda s: s["text"] != "")
        fields = "raw_name", "text", "start_line", "end_line"
        return F.transform(some, lambda s: F.struct(s["section_no"].alias("section_no"), name(s["raw_name"], s["text"]).alias("name"), *[s[f].alias(f) for f in fields]))

    def headers(found: Column) -> Column:
        at = F.transform(found, lambda x, i: F.when(_is_header(x, F.slice(found, i + 2, F.lit(3)), mode), i))
        return F.filter(at, lambda i: i.isNotNull())

    return T.bound(T.soft_lines(text), lambda found: T.bound(headers(found), lambda heads: cut(found, heads)))


def sections(docs: DataFrame, key: str, text: str, mode: str = "small") -> DataFrame:
    """(key, section_no, name, raw_name, text, start_line, end_line) of sections with text.

    ``small``: a few header names, and the name is the lower-cased header line; ``keyword``: known names only;
    ``structural``: by form as well, and named by content where the header is unknown. What precedes the first header
    has no name.
    """
    return docs.select(key, F.inline(section_list(F.col(text), mode)))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


#: Items that one inner fold of ``window_starts`` goes over, so that what it has found so far stays short.
FOLD = 1000


def joined_runs(items: Column, starts: Column, between: str = " ") -> Column:
    """The items from each start up to the next, put together: every string is cut and copied once. Both must be bound."""
    upto = lambda k: F.when(k + 1 < F.size(starts), F.get(starts, k + 1)).otherwise(F.size(items))
    return F.transform(starts, lambda s, k: F.array_join(F.slice(items, s + 1, upto(k) - s), between))


def _bullets(found: Column) -> Column:
    """Bullet lines without their marks, with the lines that follow them; what stands before the first is left out."""
    starts = F.filter(F.transform(found, lambda x, i: F.when(x.rlike(BULLET), i)), lambda i: i.isNotNull())
    bare = F.transform(found, lambda x: F.when(x.rlike(BULLET), F.trim(F.regexp_replace(x, BULLET, ""))).otherwise(x))
    return F.filter(T.bound(bare, lambda b: T.bound(starts, lambda s: joined_runs(b, s))), lambda b: F.length(b) > 3)


def window_starts(sizes: Column, limit: int = WINDOW) -> Column:
    """The items that begin a window, of items of ``sizes`` (1 or more) packed one after the other with one between them.

    The fold keeps a running length and stores item numbers; it goes over stretches of ``FOLD`` items, whose numbers
    are put together at the end, so its cost is linear in the items.
    """
    whole = "array<array<int>>"

    def stretch(s: Column, c: Column) -> Column:
        def step(t: Column, i: Column) -> Column:
            n = F.get(sizes, i)
            new = (t["at"] == 0) | (t["at"] + 1 + n > limit)
            return F.struct(F.when(new, n).otherwise(t["at"] + 1 + n).alias("at"), F.when(new, F.concat(t["done"], F.array(i))).otherwise(t["done"]).alias("done"))

        own = F.sequence(c * FOLD, F.least((c + 1) * FOLD, F.size(sizes)) - 1)
        begin = F.struct(s["at"].alias("at"), F.array().cast("array<int>").alias("done"))
        return F.aggregate(own, begin, step, lambda t: F.struct(t["at"].alias("at"), F.concat(s["done"], F.array(t["done"])).alias("done")))

    stretches = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / FOLD).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(stretches, F.struct(F.lit(0).alias("at"), F.array().cast(whole).alias("done")), stretch, lambda s: s["done"]))


def windows(sents: Column, limit: int = WINDOW) -> Column:
    """Sentences packed one after the other into windows of at most ``limit`` characters; a longer one stands alone."""
    def packed(items: Column) -> Column:
        sizes = F.transform(items, lambda x: F.length(x))
        return T.bound(T.bound(sizes, lambda n: window_starts(n, limit)), lambda starts: joined_runs(items, starts))

    return T.bound(sents, packed)


def overlapped(chunks: Column, overlap: int = OVERLAP) -> Column:
    """Each window but the first with the end of the one before in front."""
    each = lambda own: F.transform(own, lambda c, i: F.when(i == 0, c).otherwise(F.trim(F.concat(F.right(F.get(own, i - 1), F.lit(overlap)), F.lit(" "), c))))
    return T.bound(chunks, each)


def piece_list(text: Column, limit: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """A block's bullets if at least half of its lines (and two) are some, else its overlapping sentence windows."""
    found = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def cut(lines_: Column) -> Column:
        bulleted = F.size(F.filter(lines_, lambda x: x.rlike(BULLET))) >= F.greatest(F.lit(2), F.floor(F.size(lines_) / 2))
        return F.when(bulleted, _bullets(lines_)).otherwise(overlapped(windows(sentences(F.array_join(lines_, " ")), limit), overlap))

    return T.bound(found, cut)


def pieces(blocks: DataFrame, text: str, limit: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``blocks`` with ``pieces``, their ``piece_list``."""
    return blocks.withColumn("pieces", piece_list(F.col(text), limit, overlap))


def chunk_list(text: Column, mode: str = "small", limit: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """A document's pieces of 20 characters or more, in order: an array of (text, section, section_raw)."""
    def of(s: Column) -> Column:
        long_enough = F.filter(piece_list(s["text"], limit, overlap), lambda p: F.length(p) >= SHORTEST)
        return F.transform(long_enough, lambda p: F.struct(F.trim(p).alias("text"), s["name"].alias("section"), s["raw_name"].alias("section_raw")))

    return F.flatten(F.transform(section_list(text, mode), of))


def chunks(docs: DataFrame, key: str, text: str, mode: str = "small", limit: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, order, text, section, section_raw, chunk_id, chunk_id_v2): pieces of 20 characters or more, in order."""
    rows = docs.select(key, F.posexplode(chunk_list(F.col(text), mode, limit, overlap)).alias("order", "c"))
    rows = rows.select(key, "order", "c.text", "c.section", "c.section_raw")
    return rows.withColumns({"chunk_id": T.chunk_id(F.col(key), F.col("order")), "chunk_id_v2": T.content_id(F.col(key), F.col("text"))})


#: The fields of a chunk's metadata.
META = ("title", "company", "days_old", "location", "sector", "contractType", "experienceLevel", "applyType", "workType", "salary", "jobUrl", "applyUrl", "applied_times", "language")


def with_metadata(rows: DataFrame, docs: DataFrame, key: str, fields: tuple[str, ...] | list[str] = META) -> DataFrame:
    """Chunks with ``meta``, a struct of the document's ``fields``; a field that ``docs`` lacks is null."""
    some = [(F.col(f) if f in docs.columns else F.lit(None).cast("string")).alias(f) for f in fields]
    return rows.join(docs.select(key, F.struct(*some).alias("meta")), key)


def with_aspects(rows: DataFrame, chunk: str, aspects: DataFrame) -> DataFrame:
    """Chunks with ``aspects``: a map of each aspect to its values in order, of long aspects (chunk, aspect, value, pos); empty without any."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"])
    per = aspects.groupBy(chunk, "aspect").agg(values.alias("_v")).groupBy(chunk).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("aspect", "_v")))).alias("aspects"))
    return rows.join(per, chunk, "left").withColumn("aspects", F.coalesce("aspects", F.create_map().cast("map<string,array<string>>")))


#: Characters of a start that are looked for before more of it is compared.
ANCHOR = 8


def _without_start(before: Column, text: Column, longest: int) -> Column:
    """``text`` without its longest start, of at most ``longest`` characters, that ``before`` ends with."""
    def cut(end: Column, start: Column) -> Column:
        # ends shorter than the anchor, and those that begin where it stands
        shorter = F.transform(F.sequence(F.lit(0), F.least(F.lit(ANCHOR - 1), F.length(end))), lambda n: F.right(end, n))
        anchor = F.replace(F.left(start, F.lit(ANCHOR)), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        parts = F.split(end, F.concat(F.lit("(?=\\Q"), anchor, F.lit("\\E)")))
        longer = T.bound(parts, lambda p: F.transform(p, lambda x, i: F.array_join(F.slice(p, i + 1, F.size(p)), "")))
        same = F.array_max(F.transform(F.filter(F.concat(shorter, longer), lambda x: start.startswith(x)), lambda x: F.length(x)))
        return F.ltrim(F.substring(text, same + 1, F.length(text)))

    return T.bound(F.right(before, F.lit(longest)), lambda end: T.bound(F.left(text, F.lit(longest)), lambda start: cut(end, start)))


def without_overlap(rows: DataFrame, key: str, order: str, text: str, longest: int = 250) -> DataFrame:
    """(key, full_text): chunks in order, each without the start that repeats the end of the one before, blank lines between."""
    met = rows.withColumn("_before", F.lag(text).over(Window.partitionBy(key).orderBy(order)))
    cut = F.when(F.col("_before").isNull(), F.col(text)).otherwise(_without_start(F.col("_before"), F.col(text), longest))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_part").alias("p"))))
    joined = met.withColumn("_part", cut).groupBy(key).agg(parts.alias("x"))
    return joined.select(key, F.array_join(F.filter(F.transform("x", lambda r: r["p"]), lambda p: p != ""), "\n\n").alias("full_text"))


def joined_chunks(texts: Column, longest: int = 250) -> Column:
    """A document's chunks, an array in order, as ``without_overlap`` puts them together. ``texts`` must be bound."""
    parts = F.transform(texts, lambda c, i: F.when(i == 0, c).otherwise(T.bound(F.get(texts, i - 1), lambda before: _without_start(before, c, longest))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def assembled(rows: DataFrame, key: str, order: str, text: str, between: str = " ", most: int | None = None) -> DataFrame:
    """(key, full_text): the chunks' texts in order; with ``most``, of the first so many."""
    if most:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= most)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(key).agg(parts.alias("x")).select(key, F.array_join(F.transform("x", lambda r: r["t"]), between).alias("full_text"))


def preview(rows: DataFrame, key: str, order: str, text: str, size: int = 500, between: str = " ") -> DataFrame:
    """(key, preview): the first ``size`` characters of the chunks' texts in order, put together.

    Each text adds a separator at least, and no more of it than ``size`` characters can show, so the first ``size`` + 1
    texts and characters decide and no task holds all texts of a key.
    """
    some = rows.filter(F.col(text).isNotNull()).select(key, order, F.left(text, F.lit(size)).alias("_text"))
    whole = assembled(some, key, order, "_text", between, size + 1)
    return whole.select(key, F.left("full_text", F.lit(size)).alias("preview"))


def section_chunks(rows: DataFrame, key: str, section: str | None, limit: int = 10) -> DataFrame:
    """Up to ``limit`` chunks of each job, of one section if it is named, with 300 characters each; chunks without a section are no error."""
    kept = rows if section is None else rows.filter(F.lower(F.coalesce("section", F.lit(""))) == section.lower())
    n = F.row_number().over(Window.partitionBy(key).orderBy("order"))
    return kept.withColumn("_n", n).filter(F.col("_n") <= limit).select(key, "order", "section", T.snippet(F.col("text"), 300).alias("text"))


def details(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with n_chunks, chunks, full_text, sections: a document's chunks in order, its text without overlaps, and that text's sections.

    The arrays hold one document's own pieces, and all is worked out in its row. A document without a chunk has none: 0,
    empty arrays and ''.
    """
    def of(own: Column) -> Column:
        ordered = F.transform(own, lambda c, i: F.struct(i.alias("order"), c["section"].alias("section"), c["text"].alias("text")))
        named = lambda full: F.transform(section_list(full, "structural"), lambda s: F.struct(s["start_line"].alias("start_line"), F.coalesce(s["name"], F.lit("intro")).alias("name"), s["text"].alias("text")))
        whole = T.bound(F.transform(own, lambda c: c["text"]), lambda texts: joined_chunks(texts))
        return T.bound(whole, lambda full: F.struct(F.size(own).cast("long").alias("n_chunks"), ordered.alias("chunks"), full.alias("full_text"), named(full).alias("sections")))

    met = docs.withColumn("_d", T.bound(chunk_list(F.col(text)), of))
    return met.select(*docs.columns, "_d.n_chunks", "_d.chunks", "_d.full_text", "_d.sections")
