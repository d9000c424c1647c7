"""All queries of the analytics operators, by name, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with its SQL."""
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hybrid search's keyword side, one best document a query, with snippets."""
    return QUERIES["r7_search_documents"](spark, sf_dir)


for _name in ("text_queries", "ngram_queries", "search_queries", "chunk_queries", "cluster_queries", "label_queries", "name_queries", "job_queries"):
    importlib.import_module(f"loomtext.plans.{_name}")
