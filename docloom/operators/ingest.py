"""Ingest: identity, provenance, normalisation and quarantine splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import variants as V
from ..functions.rows import each
from ..functions.scalars import iso_text, nan_to_null, text_hash
from ..session import written
from .joins import lookup_join

STRUCTURAL = ("_id", "_op_type")


def assign_id(df: DataFrame, content: Sequence[str] = ()) -> DataFrame:
    """``id`` wins, then ``_id``, then a new id; both end up equal.

    A random id is drawn again when a task is retried, so new ids are a hash of the row's
    content. In a frame that has neither column every row gets one; where a column exists its
    nulls stay for the identity check (:func:`fill_id` treats them as absent instead).
    """
    has_id, has_alt = "id" in df.columns, "_id" in df.columns
    if has_id and has_alt:
        chosen = F.coalesce(F.col("id"), F.col("_id"))
    elif has_id:
        chosen = F.col("id")
    elif has_alt:
        chosen = F.col("_id")
    else:
        basis = content or df.columns
        chosen = text_hash(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in basis])
    return df.withColumn("id", chosen).withColumn("_id", F.col("id"))


def fill_id(df: DataFrame, content: Sequence[str]) -> DataFrame:
    """Like :func:`assign_id` for tables where null means absent: the rest gets a hash id."""
    basis = text_hash(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])
    known = [F.col(c) for c in ("id", "_id") if c in df.columns]
    return df.withColumn("id", F.coalesce(*known, basis)).withColumn("_id", F.col("id"))


def _set_add(df: DataFrame, field: str, value: str) -> Column:
    addition = F.array(F.lit(value))
    if field not in df.columns:
        return addition
    return F.array_union(F.coalesce(F.col(field), F.array().cast("array<string>")), addition)


def stamp(
    df: DataFrame,
    analytic: str,
    session: str,
    now: Column,
    upsert: bool = False,
    archive: bool = False,
) -> DataFrame:
    """Provenance sets, operation and system times.

    ``now`` is one literal per job, so every row and every retry carries the same time.
    """
    out = df
    if not archive:
        out = out.withColumn("analytic_session_id", _set_add(df, "analytic_session_id", session))
        out = out.withColumn("analytic_name", _set_add(df, "analytic_name", analytic))
    if upsert:
        out = out.withColumn("_op_type", F.lit("update"))
    if not archive:
        out = out.withColumn("@updated", now)
        first = F.coalesce(F.col("`@timestamp`"), now) if "@timestamp" in df.columns else now
        out = out.withColumn("@timestamp", first)
    return out


def clean_body(df: DataFrame) -> DataFrame:
    """Drop the fields that address a document but are not part of it."""
    return df.drop(*STRUCTURAL)


def missing_identity(id_col: str = "id", type_col: str = "doc_type") -> Column:
    """Message naming the identity fields that are null or empty; empty when none is."""
    checks = [
        F.when(F.coalesce(F.length(F.col(c)), F.lit(0)) == 0, F.lit(f"{c} missing"))
        for c in (id_col, type_col)
    ]
    return F.concat_ws("; ", *checks)


def split_missing_identity(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``id`` and ``doc_type``, and the quarantine of those without."""
    flagged = df.withColumn("__missing", missing_identity())
    good = flagged.filter(F.col("__missing") == "").drop("__missing")
    bad = flagged.filter(F.col("__missing") != "").select(
        F.lit("missing_fields").alias("error_type"),
        F.col("doc_type"),
        F.col("id"),
        F.col("__missing").alias("message"),
    )
    return good, bad


def split_violations(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """Split on an array of violated rules; see :mod:`docloom.operators.rules`."""
    flagged = df.withColumn("__rules", violations)
    good = flagged.filter(F.size("__rules") == 0).drop("__rules")
    bad = flagged.filter(F.size("__rules") > 0).select(
        F.lit("jsonschema").alias("error_type"),
        F.col("doc_type"),
        F.col("id"),
        F.array_join("__rules", "; ").alias("message"),
    )
    return good, bad


class IngestError(ValueError):
    """Raised in strict mode when at least one document was rejected."""


def strictly(bad: DataFrame) -> None:
    """Strict mode: one bounded look at the quarantine, then raise."""
    first = bad.limit(1).collect()
    if first:
        raise IngestError(f"{first[0]['error_type']}: {first[0]['id']}: {first[0]['message']}")


def field_families(df: DataFrame, body: str = "body", seq: str = "seq") -> DataFrame:
    """First storage family of every field: ``doc_type, path, family``.

    One partial aggregate; the result is as long as the field lists, not as the documents. Families are
    numbers in it, so with a number as ``seq`` nothing is sorted.
    """
    names = F.array(*map(F.lit, V.FAMILIES))
    return (
        each(df, ["doc_type", seq], _family_entries(V.leaves(body)), "e")
        .filter(F.col("e.family").isNotNull())
        .groupBy("doc_type", F.col("e.path").alias("path"))
        .agg(F.min_by(F.array_position(names, F.col("e.family")).cast("int"), seq).alias("family"))
        .withColumn("family", F.element_at(names, F.col("family")))
    )


def family_maps(families: DataFrame) -> DataFrame:
    """One row per type: ``doc_type, first map<path,family>``."""
    return families.groupBy("doc_type").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "family"))).alias("first")
    )


def _family_entries(all_leaves: Column) -> Column:
    """Leaf families plus an ``object`` entry for every ancestor path."""

    def expand(leaf: Column) -> Column:
        path = leaf["path"]
        above = F.when(
            F.size(path) > 1,
            F.transform(
                F.sequence(F.lit(1), F.size(path) - 1),
                lambda k: F.struct(
                    V.path_text(F.slice(path, F.lit(1), k)).alias("path"),
                    F.lit("object").alias("family"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<path:string,family:string>>"))
        own = F.struct(V.path_text(path).alias("path"), V.family(leaf["value"]).alias("family"))
        return F.concat(F.array(own), above)

    return F.array_distinct(F.flatten(F.transform(all_leaves, expand)))


def conflicting_paths(first: Column, all_leaves: Column) -> Column:
    """Paths whose value does not fit the family seen first, or that lie below a plain field."""

    def below_plain(path: Column) -> Column:
        return F.when(
            F.size(path) > 1,
            F.exists(
                F.sequence(F.lit(1), F.size(path) - 1),
                lambda k: F.coalesce(
                    F.try_element_at(first, V.path_text(F.slice(path, F.lit(1), k))) != "object",
                    F.lit(False),
                ),
            ),
        ).otherwise(False)

    def clash(leaf: Column) -> Column:
        own_first = F.try_element_at(first, V.path_text(leaf["path"]))
        return ~V.fits_family(own_first, leaf["value"]) | below_plain(leaf["path"])

    return F.transform(F.filter(all_leaves, clash), lambda leaf: V.path_text(leaf["path"]))


def flag_conflicts(df: DataFrame, families: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``__bad``: the conflicting paths of each document.

    The family maps (one row per type) meet the documents in a size-checked join.
    """
    joined = lookup_join(df, family_maps(families), ["doc_type"], "left")
    paths = conflicting_paths(F.col("first"), V.leaves(body))
    return joined.withColumn(
        "__bad",
        F.coalesce(
            F.when(F.col("first").isNotNull(), paths), F.array().cast("array<string>")
        ),
    ).drop("first")


def split_conflicts(
    df: DataFrame, body: str = "body", seq: str = "seq", known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Reject documents whose fields do not fit the family seen first.

    ``known`` carries families of documents stored earlier; without it the batch decides. Only
    the offending document is lost, the rest of the batch is kept.
    """
    families = known if known is not None else written(field_families(df, body, seq), "families")
    flagged = flag_conflicts(df, families, body)
    good = flagged.filter(F.size("__bad") == 0).drop("__bad")
    bad = flagged.filter(F.size("__bad") > 0).select(
        F.lit("BulkIndexError").alias("error_type"),
        "doc_type",
        "id",
        F.array_join("__bad", "; ").alias("message"),
    )
    return good, bad


def ingest_counts(df: DataFrame) -> DataFrame:
    """Documents per type, for the run record."""
    return df.groupBy("doc_type").agg(F.count("*").alias("n_docs"))


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null and timestamps become ISO text, in every column."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_text(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(
            f.dataType.elementType, (T.DoubleType, T.FloatType)
        ):
            c = F.transform(c, nan_to_null)
        cols.append(c.alias(f.name))
    return df.select(*cols)
