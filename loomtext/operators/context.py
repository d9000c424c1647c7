"""Contexts within a token budget, and conversation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import within_budget

# Budget, and (rows, characters, separator) of each tier.
BUDGET = 4000
TIERS = {0: (50, None, "\n"), 1: (15, 500, "\n\n"), 2: (5, 2000, "\n\n"), 3: (2, 3000, "\n\n")}


def block(tier: int, rank: Column, title: Column, company: Column, text: Column, section: Column | None = None) -> Column:
    """One row's part of a context; of tier 0 the text is its summary line."""
    if tier == 0:
        return text
    title, company = F.coalesce(title, F.lit("?")), F.coalesce(company, F.lit("?"))
    head = F.concat(F.lit("[") if tier == 1 else F.lit("## "), *([rank.cast("string"), F.lit("] ")] if tier == 1 else []), title, F.lit(" — "), company)
    if section is not None and tier < 3:
        head = F.when(F.coalesce(section, F.lit("")) != "", F.concat(head, F.lit(" ["), section, F.lit("]"))).otherwise(head)
    return F.concat(head, F.lit("\n"), T.snippet(text, TIERS[tier][1]))


def context(rows: DataFrame, tier: int, group: str, rank: str, part: Column, budget: int = BUDGET) -> DataFrame:
    """(group, context, n_used): the parts in rank order while their estimated tokens are within the budget."""
    most, _, between = TIERS[tier]
    used = within_budget(rows.filter(F.col(rank) <= most).withColumn("_part", part), group, rank, T.token_estimate(F.col("_part")), budget)
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("_part").alias("p"))))
    return used.groupBy(group).agg(parts.alias("x")).select(group, F.array_join(F.transform("x", lambda r: r["p"]), between).alias("context"), F.size("x").cast("long").alias("n_used"))


def recent_turns(messages: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def folded(turns: Column, n: int = 5) -> Column:
    """How many turns the summary holds: at 2n + 1 turns the first n + 1, and n + 1 more after every n + 1 turns."""
    return F.when(turns > 2 * n, (n + 1) * (F.floor((turns - 2 * n - 1) / (n + 1)) + 1)).otherwise(0)


def summaries(messages: DataFrame, n: int = 5, chars: int = 100) -> DataFrame:
    """(conv_id, folded, summary): the folded turns, a line each for users and assistants."""
    sizes = messages.groupBy("conv_id").agg(F.count("*").alias("_t"))
    rows = messages.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).join(sizes, "conv_id").withColumn("folded", folded(F.col("_t"), n))
    who = F.when(F.col("role") == "user", "User asked: ").when(F.col("role") == "assistant", "Assistant: ")
    line = F.when((F.col("_n") <= F.col("folded")) & who.isNotNull(), F.struct("_n", F.concat(who, T.snippet(F.col("text"), chars)).alias("l")))
    lines = F.array_sort(F.collect_list(line))
    return rows.groupBy("conv_id").agg(F.max("folded").alias("folded"), lines.alias("x")).select("conv_id", "folded", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("summary"))


def mentions(messages: DataFrame, last: int = 10) -> DataFrame:
    """(conv_id, urls): the last mentioned addresses, by first mention."""
    each = messages.select("conv_id", "turn", F.posexplode(T.urls(F.col("text"))).alias("p", "url"))
    first = each.groupBy("conv_id", "url").agg(F.min(F.struct("turn", "p")).alias("at"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("at")))
    kept = first.withColumn("_n", n).filter(F.col("_n") <= last)
    return kept.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]).alias("urls"))


def memory(messages: DataFrame, n: int = 5) -> DataFrame:
    """(conv_id, recent, folded, summary, urls): what a conversation remembers."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    recent = recent_turns(messages, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("recent"))
    return recent.join(summaries(messages, n), "conv_id").join(mentions(messages), "conv_id", "left")
