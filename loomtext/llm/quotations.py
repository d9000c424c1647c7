"""Quotation linking in chats, in DataFrame functions only.

A line's quote level is its number of leading ``>``. Lines next to each other of one level are a passage; normalised
(letters lower-cased, white space collapsed, lines without a letter or digit left out), it is hashed and joined to the
first message of the conversation that holds the same lines, one after the other, as its own. Lines of a passage that no
message before holds as a whole are looked up one by one. Messages without quotes skip all that. A message replies to
the message that most of its quoted lines come from, level by level outwards: the lines of level 1 decide, if any of
them is known. Threads are what explicit replies link; their roots are found by pointer doubling. Sorted by (conv_id,
thread, turn), a conversation is in reply order: every reply comes after what it answers, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: One character class after the first mark: no repeated group, on which long runs would recurse.
_MARK = r"^[ \t]*>[> \t]*"
#: Turns are ranked within stretches of so many, so that a long conversation is no single group.
STRETCH = 64


def level(line: Column) -> Column:
    """Number of ``>`` before the line's text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, f"({_MARK})", 1), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARK, "")), r"(?U)\s+", " "))


def _hash(line: Column) -> Column:
    return F.md5(line)


def own_text(text: Column) -> Column:
    """The text without its quoted lines, trimmed."""
    return F.btrim(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_MARK)), "\n"), F.lit(" \t\n\x0b\f\r"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def passages(text: Column) -> Column:
    """Array of (level, lines): runs of normalised lines of one level, without lines that have no letter or digit; level 0 is the message's own."""
    each = F.transform(F.split(text, "\n"), lambda x: F.struct(level(x).alias("level"), normalised(x).alias("line")))

    def runs(rows: Column) -> Column:
        first = F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | (x["level"] != F.get(rows, i - 1)["level"]), i)), lambda i: i.isNotNull())
        upto = lambda starts, k: F.when(k + 1 < F.size(starts), F.get(starts, k + 1)).otherwise(F.size(rows))
        cut = lambda starts: F.transform(starts, lambda s, k: F.struct(F.get(rows, s)["level"].alias("level"), F.slice(rows, s + 1, upto(starts, k) - s)["line"].alias("lines")))
        return _bound(first, cut)

    return _bound(F.filter(each, lambda x: x["line"].rlike(r"[\p{L}\p{N}]")), runs)


def links(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of messages (conv_id, turn, text): (conv_id, turn, n_quoted, max_level) of those that quote, and their links (conv_id, turn, level, reply_to, lines).

    The original of a passage is the earliest turn that has its lines unquoted, one after the other; it must be before
    the quoting one. Else each of its lines counts for the earliest turn that has it, if that is before.
    """
    quoting = messages.filter(F.col("text").rlike("(?m)" + _MARK))
    levels = F.filter(F.transform(F.split("text", "\n"), level), lambda n: n > 0)
    per = quoting.select("conv_id", "turn", levels.alias("l")).filter(F.size("l") > 0).groupBy("conv_id", "turn").agg(F.sum(F.size("l")).alias("n_quoted"), F.max(F.array_max("l")).alias("max_level"))
    asked = quoting.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).filter("p.level > 0")
    asked = C.written(asked.select("conv_id", "turn", "p.level", "p.lines").distinct())
    # only conversations that quote need their lines indexed, in passages of the lengths that are asked for
    lengths = asked.groupBy("conv_id").agg(F.array_union(F.array(F.lit(1)), F.collect_set(F.size("lines"))).alias("lengths"))
    own = messages.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).filter("p.level = 0").select("conv_id", "turn", "p.lines")
    own = C.null_safe(own, lengths, ["conv_id"], "inner").select("conv_id", "turn", "lines", F.explode("lengths").alias("n")).filter(F.col("n") <= F.size("lines"))
    at = F.explode(F.sequence(F.lit(1), F.size("lines") - F.col("n") + 1)).alias("at")
    held = own.select("conv_id", "turn", "lines", "n", at).select("conv_id", "turn", _hash(F.array_join(F.slice("lines", F.col("at"), F.col("n")), "\n")).alias("hash"))
    first = C.written(held.groupBy("conv_id", "hash").agg(F.min("turn").alias("source")))

    def found(rows: DataFrame) -> DataFrame:
        return C.null_safe(rows, first, ["conv_id", "hash"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))

    whole = C.written(found(asked.withColumn("hash", _hash(F.array_join("lines", "\n")))))
    lines = whole.filter("source is null").select("conv_id", "turn", "level", F.explode("lines").alias("line")).distinct()
    single = found(lines.withColumn("hash", _hash(F.col("line")))).filter("source is not null").select("conv_id", "turn", "level", "source", F.lit(1).alias("n"))
    met = whole.filter("source is not null").select("conv_id", "turn", "level", "source", F.size("lines").alias("n")).union(single)
    return per, met.groupBy("conv_id", "turn", "level", F.col("source").alias("reply_to")).agg(F.sum("n").alias("lines"))


def replies(found: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked): the innermost known level decides, then most lines, then the latest original."""
    best = F.max(F.struct((-F.col("level")).alias("level"), "lines", "reply_to")).alias("best")
    return found.groupBy("conv_id", "turn").agg(best, F.sum("lines").alias("n_linked")).select("conv_id", "turn", F.col("best.reply_to").alias("reply_to"), "n_linked")


def roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of the messages that reply: pointers double until all stand at a message that doesn't."""
    now = C.cut(parents.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")))
    while True:
        step = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        jumped = C.null_safe(now, step, ["conv_id", "root"], "left")
        if jumped.filter("further is not null").isEmpty():
            return now
        now = C.cut(jumped.select("conv_id", "turn", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def preceding(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, before): the next smaller turn of the conversation, found within stretches of turns."""
    cells = turns.select("conv_id", "turn").distinct().withColumn("cell", F.floor(F.col("turn") / STRETCH))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "cell").orderBy("turn"))
    last = cells.groupBy("conv_id", "cell").agg(F.max("turn").alias("last"))
    last = last.withColumn("carry", F.lag("last").over(Window.partitionBy("conv_id").orderBy("cell"))).drop("last")
    return C.null_safe(cells.withColumn("inside", inside), C.written(last), ["conv_id", "cell"], "left").select("conv_id", "turn", F.coalesce("inside", "carry").alias("before"))


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, content, n_quoted, max_level, n_linked, reply_to, thread, depth, for each row of ``messages``.

    content: the text without quoted lines. reply_to: the turn that its quotes come from, else the turn before, else
    null. thread: the turn at which the chain of quoting replies begins, the message's own if it answers none; depth:
    the chain's length. Sort by conv_id, thread and turn for reply order. Null texts are empty; a null turn has no
    reply and no thread; messages with a null conv_id form one conversation; repeated rows are kept and equal; several
    texts of one turn count as one message for links. An empty table gives no rows.
    """
    slim = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = slim.filter("turn is not null")
    per, found = links(known)
    parents = C.written(replies(found))
    chain = roots(parents)
    told = C.null_safe(per, parents, ["conv_id", "turn"], "left")
    told = C.written(C.null_safe(told, chain, ["conv_id", "turn"], "left"))
    out = C.null_safe(slim, told, ["conv_id", "turn"], "left")
    out = C.null_safe(out, C.written(preceding(known)), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", own_text(F.col("text")).alias("content"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("reply_to", "before").alias("reply_to"), F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """All conversations one after the other, each in reply order; a range sort, so a long conversation spans tasks."""
    return linked.orderBy("conv_id", "thread", "turn", "role", "content")
