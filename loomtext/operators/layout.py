"""Labels of clusters at two levels, and which of them can be shown without overlapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import NOISE, label_positions
from .store import numbered, written
from .tfidf import term_counts, top_terms

# A character's width, a line's height and the room between labels, as shares of the plot.
CHARACTER, LINE, PADDING = 0.011, 0.025, 0.004
#: Undecided labels that one task decides in order, at most.
REST = 2000


def scoped_terms(docs: DataFrame, scope: str, key: str, text: str, top_n: int = 5, max_features: int = 10_000) -> DataFrame:
    """(scope, key, term, score, rank): class-based TF-IDF of the ``key`` groups within each ``scope``, whose texts alone count for it."""
    slim = docs.select(F.struct(F.col(scope).alias("s"), F.col(key).alias("k")).alias("_of"), F.col(text).alias("_text"))
    counts = written(term_counts(slim, "_of", "_text", 2).select(F.col("_of.s").alias(scope), F.col("_of.k").alias(key), "term", "tf"))
    groups = docs.select(scope, key).distinct().groupBy(scope).agg(F.count("*").alias("n"))
    per = counts.groupBy(scope, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("freq"))
    place = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("freq"), "term"))
    kept = per.withColumn("_place", place).filter(F.col("_place") <= max_features).join(groups, scope)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = counts.join(kept.select(scope, "term", idf.alias("idf")), [scope, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(scope, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = raw.join(norm, [scope, key]).select(F.struct(scope, key).alias("_of"), "term", (F.col("w") / F.col("norm")).alias("score"))
    return top_terms(scored, "_of", top_n).select(f"_of.{scope}", f"_of.{key}", "term", "score", "rank")


def two_level_labels(points: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """(cluster_id, sub_id, level, text, x, y, priority) of points (cluster_id, sub_id, x, y, ``text``) and clusters' names (cluster_id, label).

    Level 0: each cluster at the mean of its points, ``Cluster n`` if it has no name; level 1: each part of a cluster
    that has several, by its first two terms among the cluster's own texts. A part without a term has no label, nor has
    one whose label equals the cluster's (in lower case). priority: the number of points. Noise has none.
    """
    own = points.filter(F.col("cluster_id") != NOISE)
    named = names.select("cluster_id", F.col("label").alias("_label"))
    label = F.coalesce(F.when(F.trim("_label") != "", F.col("_label")), F.concat(F.lit("Cluster "), "cluster_id"))
    first = written(label_positions(own).join(named, "cluster_id", "left").withColumn("text", label).drop("_label"))
    split = own.groupBy("cluster_id").agg(F.count_distinct("sub_id").alias("_parts")).filter("_parts > 1").select("cluster_id")
    parts = own.join(split, "cluster_id", "left_semi")
    terms = scoped_terms(parts, "cluster_id", "sub_id", text, 2)
    words = terms.groupBy("cluster_id", "sub_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]), ", ").alias("text"))
    second = label_positions(parts, 1).join(words, ["cluster_id", "sub_id"]).join(first.select("cluster_id", F.col("text").alias("_above")), "cluster_id")
    second = second.filter(F.lower(F.trim("text")) != F.lower(F.trim("_above")))
    columns = ["cluster_id", "sub_id", "level", "text", "x", "y", "priority"]
    return first.select(columns).union(second.select(columns))


def _boxes(labels: DataFrame, span_x: float, span_y: float) -> DataFrame:
    half_w = 0.5 * CHARACTER * span_x * F.greatest(F.length("text"), F.lit(1))
    half_h = F.lit(0.5 * LINE * span_y)
    return labels.withColumns({"_x0": F.col("x") - half_w, "_x1": F.col("x") + half_w, "_y0": F.col("y") - half_h, "_y1": F.col("y") + half_h})


def _meet(a: str, b: str, room: float) -> Column:
    apart = [F.col(f"{p}_{axis}1") + room < F.col(f"{q}_{axis}0") for axis in "xy" for p, q in ((a, b), (b, a))]
    return ~(apart[0] | apart[1] | apart[2] | apart[3])


def _in_order(rows):
    """Keeps boxes of one level in their order, each that meets none kept before."""
    import pandas as pd

    kept: list[tuple] = []
    for r in rows.sort_values("_no").itertuples(index=False):
        if not any(r[2] <= k[3] and k[2] <= r[3] and r[4] <= k[5] and k[4] <= r[5] for k in kept):
            kept.append(tuple(r))
    return pd.DataFrame(kept, columns=rows.columns)


def without_overlaps(labels: DataFrame, span_x: float, span_y: float) -> DataFrame:
    """The rows of ``labels`` (level, text, x, y, priority, ...) that are shown: those of their level that meet no shown one of a higher priority.

    Ties of priority go by text, then place. The result is that of taking each level's labels one by one in this order;
    here, in every round, each label that comes before all undecided ones in its grid cells is kept, and undecided ones
    that meet it go. Kept boxes of a cell don't meet, so a cell has few of them, and no pairs of all labels arise. When
    few are left, one task takes them in order. Rows without a level, text, place or priority are left out.
    """
    room = PADDING * max(span_x, span_y)
    # half the room on each side: boxes that meet share a cell
    cell_w, cell_h = max(4 * CHARACTER * span_x + room, 1e-300), max(LINE * span_y + room, 1e-300)
    full = labels.filter(" and ".join(f"{c} is not null" for c in ("level", "text", "x", "y", "priority")))
    ordered = numbered(_boxes(full.withColumn("_down", -F.col("priority")), span_x, span_y), ["level", "_down", "text", "x", "y"], "_no")
    ordered = written(ordered.drop("_down"))
    boxes = ordered.select("level", "_no", F.col("_x0") - room / 2, F.col("_x1") + room / 2, F.col("_y0") - room / 2, F.col("_y1") + room / 2).toDF("level", "_no", "_x0", "_x1", "_y0", "_y1")

    def in_cells(df: DataFrame) -> DataFrame:
        ends = [F.sequence(F.floor(F.col(f"_{a}0") / size), F.floor(F.col(f"_{a}1") / size)) for a, size in (("x", cell_w), ("y", cell_h))]
        return df.withColumn("_cx", F.explode(ends[0])).withColumn("_cy", F.explode(ends[1]))

    open_, kept = written(boxes), None
    while open_.limit(REST + 1).count() > REST:
        cells = written(in_cells(open_))
        least = cells.groupBy("level", "_cx", "_cy").agg(F.min("_no").alias("_least"))
        lead = cells.join(least, ["level", "_cx", "_cy"]).groupBy("_no").agg(F.min(F.col("_no") == F.col("_least")).alias("_first")).filter("_first").select("_no")
        now = written(open_.join(lead, "_no"))
        kept = now if kept is None else kept.union(now)
        other = in_cells(now).select("level", "_cx", "_cy", *[F.col(c).alias(f"k{c}") for c in ("_no", "_x0", "_x1", "_y0", "_y1")])
        gone = cells.join(other, ["level", "_cx", "_cy"]).filter(_meet("", "k", 0.0)).select("_no").distinct()
        open_ = written(open_.join(gone, "_no", "left_anti"))
    last = open_.groupBy("level").applyInPandas(_in_order, open_.schema)
    shown = last.select("_no") if kept is None else kept.select("_no").union(last.select("_no"))
    return ordered.join(shown, "_no").drop("_no", "_x0", "_x1", "_y0", "_y1")
