"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base findings are three kinds of pattern matches. Beyond them, every long mixed token is a candidate: the hash of its
value is counted over the corpus by distinct repositories and owners. A value that one owner alone has, however often,
looks like a live credential and its spans are added (kind ``bare``); a value that several owners have is a widely
copied example. The same frequencies tell live base findings from examples. A limit on repositories can be set where
they are real ones.

Positions come from splitting a text at the matches of a pattern: the lengths of what lies between and of the matches
add up to code-point offsets, so the regular expression alone decides what matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# The patterns of the base kinds, in the order that breaks ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A candidate: 16 or more of these characters, with a digit, a letter and no base finding around it.
BARE = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "bare")
#: A value of at most so many owners looks live.
LIVE_OWNERS = 1

_SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def spans(text: Column, kind: str, pattern: str, value: str | None = None) -> Column:
    """All leftmost non-overlapping matches as (start, end, kind, value); ``value``: what to take from a match, default all."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # lengths first: positions are sums of them, over the few matches that a text has
    own = F.transform(found, lambda m: F.length(m))
    gap = F.transform(F.slice(between, 1, F.size(found)), lambda g: F.length(g))
    zero = F.lit(None).cast("array<struct<start:int,end:int>>")
    state = F.aggregate(
        F.zip_with(gap, own, lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), F.coalesce(zero, F.array().cast("array<struct<start:int,end:int>>")).alias("done")),
        lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["done"], F.array(F.struct((s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + x["m"]).alias("end")))).alias("done")),
    )["done"]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if value == "group2" else found
    joined = F.zip_with(state, values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value")))
    return F.when(text.rlike(pattern), joined).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """The base findings of each kind; text must not be null."""
    assign = F.filter(spans(text, "assign", ASSIGN, "group2"), lambda s: F.length(s["value"]) >= 6)
    return {"assign": assign, "access": spans(text, "access", ACCESS), "hex": spans(text, "hex", HEX)}


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame, live_owners: int = LIVE_OWNERS, live_repos: int | None = None) -> DataFrame:
    """(hash, owners, repos, live) of candidates (hash, owner, repo): counts of distinct ones, added up before each shuffle."""
    pairs = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("c"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    few = F.lit(True) if live_repos is None else F.col("repos") <= live_repos
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).withColumn("live", (F.col("owners") <= live_owners) & few)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", live_owners: int = LIVE_OWNERS, live_repos: int | None = None) -> DataFrame:
    """doc_id, key, n_assign, n_access, n_hex, base (listed), spans (listed), found (array), n_live, for each row of ``docs``.

    ``found``: all spans with value and ``live`` (null owners and repositories count as one owner or repository of
    their own). n_live: spans whose value looks owner-specific. Null and empty texts have none; repeated rows get equal
    results and count once in the frequencies of their owner and repository. ``key`` is a hash of the text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_key(text).alias("key"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text.alias("text"))
    kinds = base_spans(F.col("text"))
    bare = F.filter(spans(F.col("text"), "bare", BARE), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    found = slim.withColumns(kinds | {"bare": bare}).withColumn("base", F.concat(*kinds))
    clear = F.filter("bare", lambda b: ~F.exists("base", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    found = found.withColumn("all", F.concat("base", clear)).select("doc_id", "key", "owner", "repo", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], listed(F.col("base")).alias("base"), "all")
    rows = C.written(found)
    each = rows.filter(F.size("all") > 0).select("doc_id", "key", "owner", "repo", F.explode("all").alias("s")).withColumn("hash", F.xxhash64("s.value"))
    counts = C.written(ownership(each.select("hash", "owner", "repo"), live_owners, live_repos))
    rated = each.join(counts, "hash").filter("live or s.kind <> 'bare'")
    per = rated.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s.start", "s.end", "s.kind", "s.value", "live")).alias("found"))
    out = C.null_safe(rows.drop("all", "owner", "repo"), C.written(per), ["doc_id", "key"], "left")
    found_ = F.coalesce("found", F.array().cast("array<struct<start:int,end:int,kind:string,value:string,live:boolean>>"))
    return out.withColumn("found", F.array_sort(found_)).withColumn("spans", listed(F.col("found"))).withColumn("n_live", F.size(F.filter("found", lambda s: s["live"])).cast("long"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each of the (sorted) spans replaced by ``mark``; overlapping ones by one mark."""
    state = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))).otherwise(s["out"]).alias("out"),
        ),
    )
    rest = F.substring(text, state["at"] + 1, F.length(text))
    return F.when(F.size(found) > 0, F.concat(F.array_join(state["out"], ""), rest)).otherwise(text)
