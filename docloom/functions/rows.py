"""Arrays to rows, and values computed once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def each(
    df: DataFrame, keep: Sequence[str | Column], array: Column, name: str, at: str | None = None
) -> DataFrame:
    """One row per array element: the kept columns, the element, and its 0-based place.

    Below a plain ``explode`` the optimizer infers ``size(array) > 0`` and so evaluates the array
    expression a second time, with everything it depends on. The outer generator has no such
    inference; its one row for an empty array is dropped afterwards by the missing position.
    """
    place = at or "__at"
    out = df.select(*keep, F.posexplode_outer(array).alias(place, name)).filter(
        F.col(place).isNotNull()
    )
    return out if at else out.drop(place)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
