"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A paragraph is cut at its sentences and clauses; each such passage is hashed (SHA-256) to a wide vector of 256 bits, and
a paragraph's vector is the sum of its passages', a document's that of its paragraphs'. Sums are taken lane by lane
modulo 2^16, four lanes to a 64-bit word, beside the number of passages modulo 2^63. So the fingerprint doesn't depend
on the order of paragraphs, and texts are put in or taken out by ``plus`` and ``minus`` without reading the rest.

Every lane of a document differs from half its number of passages as a random sum of +1 and -1 would, one for each
passage. The cosine of two documents' differences therefore tells the share of passages that they have in common, within
about a sixteenth; texts with equal fingerprints have 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LANES, BITS = 256, 16
#: Lanes of 16 bits in a 64-bit word, words that a quarter of the hash (64 bits) is spread over.
PACKED, WORDS = 64 // BITS, BITS
#: Passages whose packed sums stay within their lanes.
SUMMED = (1 << 15) - 1
#: Passages end at line breaks, and after these marks with a blank.
_CUT = r"\n+|[.,;:!?] +"

_ONES, _LOW7, _LOW8, _LOW = 0x0001000100010001, 0x00007FFF7FFF7FFF, 0x0000800080008000, 0x0000FFFFFFFFFFFF


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def passages(text: Column) -> Column:
    """The passages of a text's paragraphs, without empty ones."""
    return F.filter(F.split(text, _CUT, -1), lambda p: p != "")


def _plus(x: Column, y: Column) -> Column:
    """Lane by lane modulo 2^16: the highest bit of a lane is added apart, so nothing runs over, and so is the highest lane."""
    low = (x.bitwiseAND(F.lit(_LOW7)) + y.bitwiseAND(F.lit(_LOW7))).bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(F.lit(_LOW8)))
    return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, 48) + F.shiftrightunsigned(y, 48), 48))


def _minus(x: Column, y: Column) -> Column:
    low = (x.bitwiseAND(F.lit(_LOW)).bitwiseOR(F.lit(_LOW8)) - y.bitwiseAND(F.lit(_LOW7))).bitwiseXOR(x.bitwiseXOR(F.bitwise_not(y)).bitwiseAND(F.lit(_LOW8)))
    return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, 48) - F.shiftrightunsigned(y, 48), 48))


def fingerprint(text: Column) -> Column:
    """struct(n, words) of a text that isn't null: the number of passages, and the packed lanes.

    Bit b (from the right) of the q-th quarter of a passage's hash is added to lane b // 16 of word 16 q + b % 16.
    """
    def quarters(h: Column) -> Column:
        return F.array(*[F.conv(F.substring(h, 1 + 16 * q, 16), 16, -10).cast("long") for q in range(LANES // 64)])

    def summed(part: Column) -> Column:
        def spread(quarter: Column) -> Column:
            word = lambda i: F.aggregate(quarter, F.lit(0).cast("long"), lambda s, h: s + F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(_ONES)))
            return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)

        # a quarter's words are taken out once, so that the inner step is a shift, a mask and a sum
        return F.concat(*[_let(F.transform(part, lambda h: F.get(h, q)), spread) for q in range(LANES // 64)])  # noqa: B023

    def together(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), lambda s, p: F.zip_with(s, p, _plus))

    def whole(hashed: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(hashed) / SUMMED).cast("int")), lambda c: _let(F.slice(hashed, c * SUMMED + 1, F.lit(SUMMED)), summed))
        return F.struct(F.size(hashed).cast("long").alias("n"), _let(parts, together).alias("words"))

    return _let(F.transform(F.transform(passages(text), lambda p: F.sha2(p.cast("binary"), 256)), quarters), whole)


def plus(x: Column, y: Column) -> Column:
    """The fingerprint of what both have."""
    return F.struct((x["n"] + y["n"]).alias("n"), F.zip_with(x["words"], y["words"], _plus).alias("words"))


def minus(x: Column, y: Column) -> Column:
    """The fingerprint of x without the passages of y."""
    return F.struct((x["n"] - y["n"]).alias("n"), F.zip_with(x["words"], y["words"], _minus).alias("words"))


def as_text(x: Column) -> Column:
    """The number of passages in decimal, and the words in hexadecimal."""
    return F.concat_ws(":", x["n"].cast("string"), F.array_join(F.transform(x["words"], lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), ""))


def differences(x: Column) -> Column:
    """Twice each lane less the number of passages, between -2^15 and 2^15."""
    def lane(w: Column, i: int) -> Column:
        return F.pmod(2 * F.shiftrightunsigned(w, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)) - x["n"] + (1 << (BITS - 1)), F.lit(1 << BITS)) - (1 << (BITS - 1))
    return F.flatten(F.transform(x["words"], lambda w: F.array(*[lane(w, i) for i in range(PACKED)])))


def _inner(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, p: s + p)


def cosine(p: Column, q: Column) -> Column:
    """0 to 1, of two ``differences``: negative ones are 0; two of texts without passages are equal, one has 0."""
    x, y = _inner(p, p), _inner(q, q)
    angle = F.round(_inner(p, q) / F.sqrt(x.cast("double") * y), 6)
    return F.when((x == 0) | (y == 0), ((x == 0) & (y == 0)).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), angle)))


def likeness(x: Column, y: Column) -> Column:
    """0 to 1: the share of passages that two fingerprints have in common, within about a sixteenth."""
    return cosine(differences(x), differences(y))


#: Stands for a null doc_id; such rows have other keys than rows with this number.
NO_ID = -(1 << 63)


def previous(keys: DataFrame) -> DataFrame:
    """(id, key, before_id, before_key, before_n, before_doc) of distinct keys (id, key, n_chars, doc_id) in their order; the last comes before the first.

    A range sort numbers them; where a part begins, and what the part before ends with, is found among the parts.
    """
    ordered = C.written(keys.repartitionByRange("id", "key").sortWithinPartitions("id", "key").withColumn("at", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.expr("shiftright(at, 33)").alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # a row for each part
    jumps = parts.select(F.col("first").alias("at"), F.lag("last").over(Window.orderBy("part")).alias("jump"), F.max("last").over(Window.partitionBy()).alias("end"))
    placed = ordered.join(jumps, "at", "left").withColumn("before", F.when(F.col("end").isNull(), F.col("at") - 1).otherwise(F.coalesce("jump", "end")))
    told = ordered.select(F.col("at").alias("before"), F.col("id").alias("before_id"), F.col("key").alias("before_key"), F.col("n_chars").alias("before_n"), F.col("doc_id").alias("before_doc"))
    return placed.join(told, "before").select("id", "key", "before_id", "before_key", "before_n", "before_doc")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, own, altered, near_edited, near_next of each row of ``docs``.

    ``edited``: the text whose last floor(n_chars / 2) code points gave way to the first as many (or all) of the next
    document; the next by ascending doc_id (null first; texts of one id by a hash, repeated rows are one document),
    after the last the first. ``own`` and ``altered``: the fingerprints of text and edited; then the likeness of the
    text to the edited one and to the next document. Null texts are empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("key"), "text")
    order = C.written(previous(rows.select("id", "key", F.length("text").alias("n_chars"), "doc_id").distinct()))
    rows = rows.select("id", "key", "text")  # the same columns on both ways, so that texts are shuffled once
    # each document sends the one before it as much of its text as that needs
    sent = rows.join(order, ["id", "key"]).select("before_id", "before_key", F.col("before_doc").alias("doc_id"), F.left("text", F.floor(F.col("before_n") / 2).cast("int")).alias("put"), fingerprint(F.col("text")).alias("following"))
    sent = sent.dropDuplicates(["before_id", "before_key"]).withColumnsRenamed({"before_id": "id", "before_key": "key"})
    met = rows.join(sent, ["id", "key"]).withColumn("n_chars", F.length("text").cast("long"))
    met = met.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")), "put"))
    met = met.select("doc_id", "n_chars", "edited", fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("altered"), "following")
    met = met.withColumns({f"d_{c}": differences(F.col(c)) for c in ("own", "altered", "following")})
    return met.select("doc_id", "n_chars", "edited", "own", "altered", cosine(F.col("d_own"), F.col("d_altered")).alias("near_edited"), cosine(F.col("d_own"), F.col("d_following")).alias("near_next"))
