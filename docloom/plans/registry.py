"""Catalog of runnable queries: name, Spark callable, optional SQL with the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None):
    """Register a query under its function name."""

    def wrap(fn: Query) -> Query:
        if fn.__name__ in CATALOG:
            raise ValueError(f"query {fn.__name__} registered twice")
        CATALOG[fn.__name__] = (fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
