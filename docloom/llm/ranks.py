"""Dense positions of rows within groups of any size, without a window per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
ROW_BITS = (1 << 33) - 1


def group_text(*columns: str | Column) -> Column:
    """One non-null string for the values of ``columns``; null sorts before all others, which sort bytewise.

    Several columns are told apart by the length of each value, which gives up the bytewise order.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    if len(parts) == 1:
        return F.coalesce(F.concat(F.lit("="), parts[0].cast("string")), F.lit("-"))
    sized = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.concat(*sized)


def ranked(rows: DataFrame, group: str, order: Sequence[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """``rows`` with their 0-based ``rank`` within ``group`` by ``order`` (nulls first) and the group's ``size``.

    ``rows`` must be a table read from files, so that the number that tells equal rows apart is the
    same when a task is repeated. ``group`` is a column of non-null strings. Rows are dealt by ranges of
    (group, order, that number): a group or a value that holds a third of all rows is cut into as many
    ranges as it needs. Each range says how many rows of each group it holds; these counts, one row
    for each range and group in it, give every range its offset.
    """
    numbered = rows.withColumn("__tie", F.monotonically_increasing_id())
    key = [F.col(group), *(F.col(c).asc_nulls_first() for c in order), F.col("__tie")]
    dealt = numbered.repartitionByRange(*key).sortWithinPartitions(*key).drop("__tie")
    placed = F.monotonically_increasing_id()
    dealt = dealt.withColumns({"__range": F.shiftright(placed, 33), "__row": placed.bitwiseAND(F.lit(ROW_BITS))})
    dealt = written(dealt, "ranges")
    held = dealt.groupBy("__range", group).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    held = held.select(
        "__range", group, "__first",
        (F.sum("__n").over(whole.orderBy("__range")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias(size),
    )
    placed = dealt.join(held, ["__range", group])
    return placed.withColumn(rank, F.col("__before") + F.col("__row") - F.col("__first")).select(*rows.columns, rank, size)
