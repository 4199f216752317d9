"""Artifact files of documents: registry, lookup and text extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import content_type, percent_encode


def remote_path(tenant: str, doc_type: Column, ident: Column, artifact_type: Column) -> Column:
    return F.concat_ws(
        "/",
        F.lit(tenant),
        F.lit("artifacts"),
        percent_encode(doc_type),
        percent_encode(ident),
        percent_encode(artifact_type),
    )


def registry(files: DataFrame, tenant: str) -> DataFrame:
    """Artifact metadata, the latest file per name.

    ``files`` has ``doc_type, id, artifact_type, filename, file_size, seq``. Latest-per-name is
    an aggregate, so a document with very many versions of one file is no hot spot.
    """
    latest = files.groupBy("doc_type", "id", "artifact_type", "filename").agg(
        F.max_by("file_size", "seq").alias("file_size")
    )
    where = remote_path(tenant, F.col("doc_type"), F.col("id"), F.col("artifact_type"))
    return latest.select(
        "doc_type",
        "id",
        "artifact_type",
        "filename",
        content_type(F.col("filename")).alias("content_type"),
        where.alias("remote_path"),
        F.concat_ws("/", where, percent_encode(F.col("filename"))).alias("remote_file_path"),
        "file_size",
    )


def attach(docs: DataFrame, reg: DataFrame) -> DataFrame:
    """Documents with ``artifacts: map<type, array<file>>``."""
    entry = F.struct("content_type", "filename", "remote_path", "remote_file_path", "file_size")
    lists = reg.groupBy("doc_type", "id", "artifact_type").agg(
        F.array_sort(F.collect_list(entry)).alias("files")
    )
    maps = lists.groupBy("doc_type", "id").agg(
        F.map_from_entries(F.collect_list(F.struct("artifact_type", "files"))).alias("artifacts")
    )
    return docs.join(maps, ["doc_type", "id"], "left")


def scan_folder(
    spark: SparkSession, path: str, skip: Sequence[str] = (), with_content: bool = False
) -> DataFrame:
    """Plain files of a folder except those whose name matches a skip pattern at its start."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"/([^/]+)$", 1)
    kept = files.withColumn("filename", name)
    for pattern in skip:
        kept = kept.filter(~F.col("filename").rlike(f"^(?:{pattern})"))
    cols = ["path", "filename", F.col("length").alias("file_size"), "modificationTime"]
    return kept.select(*cols, *(["content"] if with_content else []))


def find(artifacts: Column, artifact_type: str, filename: Column) -> Column:
    """First entry of an artifact type with a file name, null when there is none."""
    files = F.try_element_at(artifacts, F.lit(artifact_type))
    return F.get(F.filter(files, lambda f: f["filename"] == filename), 0)


def decode_text(content: Column, encoding: str | None = None) -> Column:
    """Bytes to text: a fixed charset, else UTF-8 where valid and Latin-1 otherwise."""
    if encoding:
        return F.decode(content, encoding)
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def accepted(filename: Column, extensions: Sequence[str] = (), patterns: Sequence[str] = ()) -> Column:
    """Suffix test without regard to case, or a pattern anchored at the start."""
    ok = F.lit(False)
    for e in extensions:
        ok = ok | F.lower(filename).endswith(e)
    for p in patterns:
        ok = ok | filename.rlike(f"^(?:{p})")
    return ok


def extract_text(
    docs: DataFrame,
    files: DataFrame,
    target: str,
    extensions: Sequence[str] = (),
    patterns: Sequence[str] = (),
    encoding: str | None = None,
    recompute: bool = False,
) -> DataFrame:
    """Fill ``target`` of documents that have exactly one file, from that file's text.

    ``docs`` has ``doc_type, id``; ``files`` has ``doc_type, id, filename, content`` (bytes).
    Only one text per document moves to the join; documents with more files are only counted.
    """
    usable = accepted(F.col("filename"), extensions, patterns)
    per_doc = files.groupBy("doc_type", "id").agg(
        F.count("*").alias("__n"),
        F.max(F.when(usable, F.col("filename"))).alias("__name"),
    ).filter((F.col("__n") == 1) & F.col("__name").isNotNull())
    texts = files.join(per_doc, ["doc_type", "id"]).select(
        "doc_type", "id", decode_text(F.col("content"), encoding).alias("__text")
    )
    joined = docs.join(texts, ["doc_type", "id"], "left")
    if target in docs.columns and not recompute:
        value = F.coalesce(F.col(target), F.col("__text"))
    elif target in docs.columns:
        value = F.coalesce(F.col("__text"), F.col(target))
    else:
        value = F.col("__text")
    return joined.withColumn(target, value).drop("__text")


def with_contents(
    docs: DataFrame,
    files: DataFrame,
    target: str | None = None,
    extensions: Sequence[str] = (),
    patterns: Sequence[str] = (),
    encoding: str | None = None,
    recompute: bool = False,
) -> DataFrame:
    """``docs`` with ``blobs``: every file of a document with its text, in name order.

    ``files`` has ``doc_type, id, filename, content`` (bytes) and may have ``text``, what an earlier run has extracted: it is
    kept unless ``recompute``, file by file. Files of other names have no text. A document with exactly one file gets its
    text as ``target`` as well; one without files has null ``blobs``.
    """
    fresh = F.when(accepted(F.col("filename"), extensions, patterns), decode_text(F.col("content"), encoding))
    if "text" in files.columns:
        fresh = F.coalesce(fresh, F.col("text")) if recompute else F.coalesce(F.col("text"), fresh)
    blobs = files.select("doc_type", "id", F.struct("filename", fresh.alias("content")).alias("blob"))
    blobs = blobs.groupBy("doc_type", "id").agg(F.array_sort(F.collect_list("blob")).alias("blobs"))
    out = docs.join(blobs, ["doc_type", "id"], "left")
    if target is None:
        return out
    only = F.when(F.size("blobs") == 1, F.get("blobs", F.lit(0))["content"])
    if target not in docs.columns:
        return out.withColumn(target, only)
    return out.withColumn(target, F.coalesce(only, F.col(target)) if recompute else F.coalesce(F.col(target), only))
