"""User labels of jobs, as a long table (job, label), and the log of actions that makes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_actions(log: DataFrame, job: str = "job_id", label: str = "label", action: str = "action", order: str = "seq") -> DataFrame:
    """(job, label) after all actions: the last one of a pair decides, ``add`` keeps it."""
    last = log.groupBy(job, label).agg(F.max_by(action, order).alias("_last"))
    return last.filter("_last = 'add'").drop("_last")


def add(labels: DataFrame, more: DataFrame) -> DataFrame:
    return labels.unionByName(more).dropDuplicates()


def remove(labels: DataFrame, gone: DataFrame, job: str = "job_id", label: str = "label") -> DataFrame:
    return labels.join(gone.select(job, label), [job, label], "left_anti")


def replaced(lists: DataFrame, job: str = "job_id", labels: str = "labels") -> DataFrame:
    """The long table of new label lists; jobs with empty lists vanish."""
    return lists.select(job, F.explode(F.array_distinct(labels)).alias("label"))


def merged(stored: DataFrame, local: DataFrame, job: str = "job_id", labels: str = "labels") -> DataFrame:
    """Label lists of two sources; where both have a job, the stored one counts."""
    other = local.select(job, F.col(labels).alias("_local"))
    return stored.join(other, job, "full").select(job, F.coalesce(labels, "_local").alias(labels))


def summary(labels: DataFrame, job: str = "job_id", label: str = "label") -> DataFrame:
    """One row: the distinct labels, sorted, and the number of jobs that have any."""
    return labels.agg(F.sort_array(F.collect_set(label)).alias("labels"), F.count_distinct(job).alias("n_jobs"))


def with_any(jobs: DataFrame, labels: DataFrame, chosen: list[str], job: str = "job_id", label: str = "label") -> DataFrame:
    return jobs.join(labels.filter(F.col(label).isin(chosen)).select(job), job, "left_semi")


def share(selection: DataFrame, labels: DataFrame, value, job: str = "job_id", label: str = "label") -> DataFrame:
    """One row: whether all, whether any, and how many of the selected jobs have the label."""
    have = labels.filter(F.col(label) == value).select(job).distinct().withColumn("_has", F.lit(True))
    has = F.coalesce("_has", F.lit(False))
    return selection.join(have, job, "left").agg(F.bool_and(has).alias("all_have"), F.bool_or(has).alias("any_has"), F.count_if(has).alias("n_have"))


def enriched(jobs: DataFrame, labels: DataFrame, selected: DataFrame, job: str = "job_id", label: str = "label") -> DataFrame:
    """Jobs with their labels as one string and whether they are selected."""
    joined = labels.groupBy(job).agg(F.array_join(F.sort_array(F.collect_set(F.col(label).cast("string"))), ", ").alias("labels"))
    marked = selected.select(job).distinct().withColumn("is_selected", F.lit(True))
    out = jobs.join(joined, job, "left").join(marked, job, "left")
    return out.withColumn("labels", F.coalesce("labels", F.lit(""))).withColumn("is_selected", F.coalesce("is_selected", F.lit(False)))
