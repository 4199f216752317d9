"""Collections by type and day: where documents of a type lie, and which of them a read opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.schemas import wildcard_regex


def collection_name(tenant: str, doc_type: str, day: str | None = None, prefix: str = "docs", base: str = "document") -> str:
    """Name of a collection; with ``day`` the one of the documents written on that day."""
    return "-".join([prefix, tenant, base, doc_type.lower(), *([day] if day else [])])


def write_collections(df: DataFrame, path: str, written_at: Column, mode: str = "append") -> None:
    """Write documents (``doc_type`` and others) below ``type_key=<lower-case type>/day=<yyyyMMdd>``.

    Rows are gathered by type and day and cut by bytes: a day that holds most rows gets many files, a
    small one gets one.
    """
    keyed = df.withColumns({"type_key": F.lower("doc_type"), "day": F.date_format(written_at, "yyyyMMdd")})
    keyed.hint("rebalance", "type_key", "day").write.mode(mode).partitionBy("type_key", "day").parquet(path)


def read_collections(
    spark: SparkSession, path: str, schema: str | T.StructType, doc_type: str = "*", day: str = "*", first: str | None = None, last: str | None = None
) -> DataFrame:
    """Documents of the types and days that two wildcards name, or of a range of days.

    Type and day are partitions: others are left out before any file is opened.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("type_key", T.StringType()), T.StructField("day", T.StringType())])
    out = spark.read.schema(full).parquet(path)
    for column, wanted in (("type_key", doc_type.lower()), ("day", day)):
        if wanted != "*":
            out = out.where(F.col(column).rlike(wildcard_regex(wanted)) if "*" in wanted else F.col(column) == wanted)
    if first is not None:
        out = out.where(F.col("day") >= first)
    return out if last is None else out.where(F.col("day") <= last)
