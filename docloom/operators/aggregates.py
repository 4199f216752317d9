"""Bucket and metric aggregations over filtered document sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import Clause, match_all
from ..functions.rows import each


def document_counts(df: DataFrame) -> DataFrame:
    """Number of documents per type."""
    return df.groupBy("doc_type").agg(F.count("*").alias("n_docs"))


def term_counts(
    df: DataFrame, field: str, clause: Clause | None = None, size: int | None = None
) -> DataFrame:
    """Documents per value, most frequent first.

    ``size`` keeps the first so many values; without it all are returned. Nulls have no bucket; an array element counts once per document. Counting is a partial
    aggregate, so a value that holds a third of all rows shuffles as one row per task.
    """
    hits = df.filter((clause or match_all())(df))
    if isinstance(df.select(F.col(field)).schema[0].dataType, T.ArrayType):
        values = each(hits, [], F.array_distinct(F.col(field)), "term")
    else:
        values = hits.select(F.col(field).alias("term"))
    counts = (
        values.filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count("*").alias("n_docs"))
        .orderBy(F.desc("n_docs"), F.asc("term"))
    )
    return counts if size is None else counts.limit(size)


def extremes(df: DataFrame, field: str, clause: Clause | None = None) -> DataFrame:
    hits = df.filter((clause or match_all())(df))
    return hits.agg(
        F.min(field).cast("double").alias("min_value"),
        F.max(field).cast("double").alias("max_value"),
    )


def time_range(df: DataFrame, field: str, clause: Clause | None = None) -> DataFrame:
    """First and last day as ``yyyy-MM-dd``."""
    hits = df.filter((clause or match_all())(df))
    return hits.agg(
        F.date_format(F.min(field), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max(field), "yyyy-MM-dd").alias("last_day"),
    )


def metrics(df: DataFrame, named: Mapping[str, Column], clause: Clause | None = None) -> DataFrame:
    """Several named metrics over one filtered set in a single scan."""
    hits = df.filter((clause or match_all())(df))
    return hits.agg(*[expr.alias(name) for name, expr in named.items()])
