"""Line-delimited JSON, CSV, daily logs and document archives as Spark sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import percent_encode


def write_ndjson(df: DataFrame, path: str, compression: str | None = None) -> None:
    """One JSON document per line with ISO times; null fields are written as null."""
    writer = df.write.mode("errorifexists").option("ignoreNullFields", "false")
    writer = writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)


def read_ndjson(
    spark: SparkSession, path: str, schema: str | T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Typed documents, and a quarantine of lines that are broken or hold a value of another type.

    Blank lines are skipped by the reader.
    """
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = (
        spark.read.schema(T.StructType([*typed, T.StructField("__line", T.StringType())]))
        .option("columnNameOfCorruptRecord", "__line")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        .json(path)
    )
    bad = lines.filter(F.col("__line").isNotNull())
    return (
        lines.filter(F.col("__line").isNull()).drop("__line"),
        bad.select(F.lit("json").alias("error_type"), F.col("__line").alias("data"), *typed.names),
    )


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Open documents as ``body VARIANT, doc_type, id`` and a quarantine of unparsable lines."""
    lines = (
        spark.read.text(path)
        .filter(F.length(F.trim("value")) > 0)
        .withColumn("body", F.try_parse_json("value"))
    )
    good = lines.filter(F.col("body").isNotNull()).select(
        F.try_variant_get("body", "$.doc_type", "string").alias("doc_type"),
        F.coalesce(
            F.try_variant_get("body", "$.id", "string"), F.try_variant_get("body", "$._id", "string")
        ).alias("id"),
        "body",
    )
    bad = lines.filter(F.col("body").isNull()).select(
        F.lit("json").alias("error_type"), F.col("value").alias("data")
    )
    return good, bad


def header_name(name: str) -> str:
    """Lower case with every run of non-word characters as one underscore."""
    return re.sub(r"\W+", "_", name.lower())


def read_csv(
    spark: SparkSession,
    path: str,
    integers: list[str] = (),
    id_from: str | None = "url",
    encoding: str = "UTF-8",
    multiline: bool = True,
) -> DataFrame:
    """CSV with normalised headers, empty texts as null, chosen integer columns and a hash id.

    With ``multiline`` rows may span lines inside quotes, which makes each file one task; without it large files
    are split. Columns are read as text, nothing is inferred and the table is scanned once.
    """
    raw = spark.read.options(
        header=True, multiLine=multiline, escape='"', encoding=encoding, enforceSchema=False
    ).csv(path)
    out = raw.toDF(*[header_name(c) for c in raw.columns])
    cols = []
    for c in out.columns:
        value = F.nullif(F.col(c), F.lit(""))
        cols.append((value.try_cast("long") if c in integers else value).alias(c))
    out = out.select(*cols)
    if id_from:
        out = out.withColumn("id", F.sha2(F.col(id_from), 256))
    return out


def append_daily(df: DataFrame, path: str, written_at: Column) -> None:
    """Append stored documents to a log partitioned by the day they were written."""
    df.withColumn("day", F.date_format(written_at, "yyyyMMdd")).write.mode("append").partitionBy(
        "day"
    ).json(path)


def read_daily(
    spark: SparkSession, path: str, schema: str | T.StructType, first: str = "", last: str = "9"
) -> DataFrame:
    """Documents of a day range; other days are pruned before any file is opened."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("day", T.StringType())])
    return spark.read.schema(full).json(path).filter(F.col("day").between(first, last))


def archive_name(ident: Column, by: str = "hash") -> Column:
    """Folder name of an archived document: hash of the id or the percent-encoded id."""
    return F.sha2(ident, 256) if by == "hash" else percent_encode(ident)


def write_archive(df: DataFrame, path: str, by: str = "hash") -> None:
    """Archive as JSON partitioned by type, the document's folder name kept as a column.

    One directory per document does not scale to billions of documents on object stores; the
    folder name stays addressable as ``archive_name``. Rows are gathered by type and cut by bytes, so
    a type that holds most documents gets many files and a small one gets one.
    """
    named = df.withColumn("archive_name", archive_name(F.col("id").cast("string"), by))
    named.hint("rebalance", "doc_type").write.partitionBy("doc_type").option("ignoreNullFields", "false").json(path)


def read_archive(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType(
        [
            *[f for f in fields.fields if f.name != "doc_type"],
            T.StructField("archive_name", T.StringType()),
            T.StructField("doc_type", T.StringType()),
        ]
    )
    return spark.read.schema(full).json(path)
