"""Query clauses as composable Column builders.

A clause is a function from a DataFrame to a boolean Column, so that the same clause can be
pushed into a Parquet scan, combined with others, or negated safely.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import search_terms

Clause = Callable[[DataFrame], Column]


def _type_of(df: DataFrame, field: str) -> T.DataType:
    return df.select(F.col(field)).schema[0].dataType


def match_all() -> Clause:
    return lambda df: F.lit(True)


def term(field: str, value: Any) -> Clause:
    """Exact equality; on an array field any element may match."""

    def clause(df: DataFrame) -> Column:
        if isinstance(_type_of(df, field), T.ArrayType):
            return F.array_contains(field, value)
        return F.col(field) == F.lit(value)

    return clause


def match(field: str, text: str) -> Clause:
    """Any analysed token of the query text occurs in the field; identifiers compare whole."""

    def clause(df: DataFrame) -> Column:
        if field in ("id", "_id", "doc_type"):
            return F.col(field) == F.lit(text)
        if not isinstance(_type_of(df, field), T.StringType):
            return F.col(field) == F.lit(text).cast(_type_of(df, field))
        return F.arrays_overlap(search_terms(F.col(field)), search_terms(F.lit(text)))

    return clause


def exists(field: str) -> Clause:
    """Non-null and, for arrays, not empty."""

    def clause(df: DataFrame) -> Column:
        c = F.col(field)
        if isinstance(_type_of(df, field), T.ArrayType):
            return c.isNotNull() & (F.size(c) > 0)
        return c.isNotNull()

    return clause


def must(*clauses: Clause) -> Clause:
    def clause(df: DataFrame) -> Column:
        out = F.lit(True)
        for c in clauses:
            out = out & c(df)
        return out

    return clause


def must_not(*clauses: Clause) -> Clause:
    """None of the clauses holds; a missing field does not hold, so its row passes."""

    def clause(df: DataFrame) -> Column:
        out = F.lit(True)
        for c in clauses:
            out = out & ~F.coalesce(c(df), F.lit(False))
        return out

    return clause


def bool_query(must_clauses: list[Clause] = (), must_not_clauses: list[Clause] = ()) -> Clause:
    return must(*must_clauses, must_not(*must_not_clauses))
