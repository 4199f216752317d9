"""Point, page and count queries over document tables."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import Clause, match_all
from ..session import fresh_dir
from .schemas import wildcard_regex


def project(
    df: DataFrame,
    source: Sequence[str] | None = None,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
) -> DataFrame:
    """Keep fields by name list or wildcards; unknown names are ignored."""
    kept = df.columns
    wanted = [*(source or []), *(include or [])]
    if wanted:
        kept = [c for c in kept if any(fnmatch.fnmatchcase(c, w) for w in wanted)]
    if exclude:
        kept = [c for c in kept if not any(fnmatch.fnmatchcase(c, w) for w in exclude)]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def query(
    df: DataFrame,
    clause: Clause | None = None,
    size: int | None = None,
    order: str = "id",
    **fields,
) -> DataFrame:
    """Rows that satisfy a clause; with ``size`` the first rows in key order."""
    out = df.filter((clause or match_all())(df))
    if size is not None:
        out = out.orderBy(order).limit(size)
    return project(out, **fields)


def of_types(df: DataFrame, pattern: str, type_col: str = "doc_type") -> DataFrame:
    """Documents of all types whose name matches a wildcard; prunes partitions by type."""
    if pattern == "*":
        return df
    if "*" not in pattern:
        return df.filter(F.col(type_col) == pattern)
    return df.filter(F.col(type_col).rlike(wildcard_regex(pattern)))


def get(df: DataFrame, doc_id, key: str = "id", **fields) -> DataFrame:
    return project(df.filter(F.col(key) == F.lit(doc_id)), **fields)


def multi_get(df: DataFrame, requested: DataFrame, key: str, position: str) -> DataFrame:
    """Found documents with their place in the request; repeated ids repeat.

    Sort by ``position`` when presenting. The request table may be as large as it likes: this
    is an equi-join whose strategy AQE picks from the measured sizes.
    """
    return requested.join(df, key, "inner")


def existing(requested: DataFrame, df: DataFrame, on: str) -> DataFrame:
    """Requests that are stored."""
    return requested.join(df.select(on).distinct(), on, "left_semi")


def not_stored(requested: DataFrame, df: DataFrame, on: str) -> DataFrame:
    """Requests that are not stored yet."""
    return requested.join(df.select(on).distinct(), on, "left_anti")


def types_exist(wanted: DataFrame, df: DataFrame, type_col: str = "doc_type") -> DataFrame:
    """Each wanted type with a flag whether any document of it is stored."""
    present = df.select(F.col(type_col)).distinct().withColumn("__hit", F.lit(True))
    return wanted.join(present, type_col, "left").withColumn(
        "found", F.coalesce("__hit", F.lit(False))
    ).drop("__hit")


def count(df: DataFrame, clause: Clause | None = None, alias: str = "n") -> DataFrame:
    """Hit count as a one-row table, computed without reading any other column."""
    return df.filter((clause or match_all())(df)).agg(F.count("*").alias(alias))


def page(
    df: DataFrame, clause: Clause | None, start: int, size: int, order: str | Column = "id"
) -> DataFrame:
    """One page in key order, each row carrying the exact total number of hits."""
    hits = df.filter((clause or match_all())(df))
    return hits.orderBy(order).offset(start).limit(size).withColumn("total", F.lit(hits.count()))


def page_after(df: DataFrame, clause: Clause | None, after, size: int, order: str = "id") -> DataFrame:
    """The page that follows the key ``after`` (None: the first page); its cost does not grow with the depth.

    Keys must be unique and not null, or rows that share one may be left out between pages.
    """
    hits = df.filter((clause or match_all())(df))
    if after is not None:
        hits = hits.filter(F.col(order) > F.lit(after))
    return hits.orderBy(order).limit(size)


class PageIndex:
    """Hits in key order, cut into ranges with known offsets, so that any page reads only the ranges it lies in.

    The hits are written once, one folder per range; the list of ranges is as long as the write had tasks.
    """

    def __init__(self, df: DataFrame, clause: Clause | None = None, order: Sequence[str] = ("id",)):
        self.spark, self.order = df.sparkSession, list(order)
        hits = df.filter((clause or match_all())(df))
        self.path, self.schema = fresh_dir(self.spark, "pages"), hits.schema
        dealt = hits.repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        dealt.withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(self.path)
        counts = self._rows().groupBy("__range").count().orderBy("__range").collect()
        self.first, total = [], 0
        for r in counts:
            self.first.append((r["__range"], total, r["count"]))
            total += r["count"]
        self.total = total

    def _rows(self) -> DataFrame:
        full = T.StructType([*self.schema, T.StructField("__range", T.IntegerType())])
        return self.spark.read.schema(full).parquet(self.path)

    def page(self, start: int, size: int) -> DataFrame:
        """Rows ``start`` to ``start + size``, each with the total number of hits."""
        held = [(r, first) for r, first, n in self.first if first < start + size and first + n > start]
        before = min((first for _, first in held), default=0)
        near = self._rows().where(F.col("__range").isin([r for r, _ in held])) if held else self._rows().where(F.lit(False))
        return near.drop("__range").orderBy(*self.order).offset(start - before if held else 0).limit(size).withColumn("total", F.lit(self.total).cast("long"))
