"""Upsert semantics as a fold over a change log.

A change log row carries a key, an operation (``index`` replaces, ``update`` merges, ``delete``
removes), and a sequence value that orders the rows of one key. The current state of every key
is computed with aggregates only. No window is used, so partial aggregation runs before the
shuffle and one hot key with a third of all changes stays cheap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V
from ..functions.rows import each
from ..session import even

RESETS = ("index", "delete")
# Fixed value: parts that may share the changes of one key.
SALTS = 16


def fold_columns(
    log: DataFrame,
    keys: Sequence[str],
    seq: Column,
    op: Column,
    fields: Mapping[str, tuple[Column, Column]],
) -> DataFrame:
    """Current state of typed documents.

    ``fields`` maps a name to ``(value, present)``. A present null overwrites, an absent field
    keeps what was there. Values older than the last reset of the key are forgotten. Numeric
    fields and sequences keep the aggregation hash-based, without a sort by key.
    """
    aggs = [
        F.max_by(op == "delete", seq).alias("__gone"),
        F.max(F.when(op.isin(*RESETS), seq)).alias("__reset"),
    ]
    for name, (value, present) in fields.items():
        aggs.append(F.max(F.when(present, seq)).alias(f"__seq_{name}"))
        aggs.append(F.max_by(value, F.when(present, seq)).alias(f"__val_{name}"))
    folded = log.groupBy(*keys).agg(*aggs).filter(~F.col("__gone"))
    outs = []
    for name in fields:
        fresh = F.col("__reset").isNull() | (F.col(f"__seq_{name}") >= F.col("__reset"))
        outs.append(F.when(fresh, F.col(f"__val_{name}")).alias(name))
    return folded.select(*keys, *outs)


def fold_documents(
    log: DataFrame,
    keys: Sequence[str] = ("doc_type", "id"),
    seq: str = "seq",
    op: str = "op",
    body: str = "body",
    max_depth: int | None = None,
) -> DataFrame:
    """Current state of open documents: ``keys`` plus ``body VARIANT``.

    Objects merge deeply; arrays and scalars are replaced; explicit nulls overwrite. First the
    latest value per (key, path) is taken, which drops all history before documents are put
    together again, so the second shuffle carries one row per live path. That aggregate holds texts and so sorts the paths of its
    task, hence a task gets a bounded number of changes, those of a key in a few of them.
    """
    log = even(log, *keys, F.pmod(F.xxhash64(seq), F.lit(SALTS)), least=log.sparkSession.sparkContext.defaultParallelism)
    marker = F.array(
        F.struct(
            F.array().cast("array<string>").alias("path"),
            F.parse_json(F.lit("null")).alias("value"),
            F.lit(False).alias("open"),
        )
    )
    nothing = F.filter(marker, lambda x: F.lit(False))
    leaf = F.concat(marker, F.coalesce(V.leaves(body, max_depth), nothing))
    kept = [*keys, F.col(seq).alias("__seq"), F.col(op).alias("__op")]
    exploded = each(log, kept, leaf, "__leaf").select(
        *keys,
        "__seq",
        "__op",
        F.col("__leaf.path").alias("__path"),
        F.col("__leaf.value").alias("__value"),
    )
    # an explicit null must stay apart from an absent value: keep it inside a struct
    latest = exploded.groupBy(*keys, "__path").agg(
        F.max("__seq").alias("seq"),
        F.max(F.when(~V.is_object(F.col("__value")), F.col("__seq"))).alias("scalar_seq"),
        F.max_by(F.to_json("__value"), "__seq").alias("json"),
        F.max_by("__op", "__seq").alias("last_op"),
        F.max(F.when(F.col("__op").isin(*RESETS), F.col("__seq"))).alias("reset"),
    )
    at_root = F.size("__path") == 0
    per_key = (
        latest.groupBy(*keys)
        .agg(
            F.max(F.when(at_root, F.col("last_op"))).alias("__last_op"),
            F.max(F.when(at_root, F.col("reset"))).alias("__reset"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        ~at_root,
                        F.struct(
                            F.col("__path").alias("path"),
                            F.col("seq"),
                            F.col("scalar_seq"),
                            F.col("json"),
                        ),
                    )
                )
            ).alias("__entries"),
        )
        .filter(F.col("__last_op") != "delete")
        .withColumn(
            "__entries",
            F.filter(
                "__entries",
                lambda e: F.col("__reset").isNull() | (e["seq"] >= F.col("__reset")),
            ),
        )
    )
    resolved = per_key.withColumn("__entries", _without_conflicts(F.col("__entries")))
    return resolved.select(*keys, F.parse_json(V.rebuild(F.col("__entries"))).alias("body"))


def _is_ancestor(short: Column, long: Column) -> Column:
    return (F.size(short) < F.size(long)) & (F.slice(long, F.lit(1), F.size(short)) == short)


def _without_conflicts(entries: Column) -> Column:
    """Resolve a path that was a scalar at one time and an object at another.

    Sorted paths put descendants right behind their ancestor, so a look at neighbours tells
    whether there is anything to resolve; nearly all documents skip the pairwise check.
    """

    def neighbour_conflict(e: Column, i: Column) -> Column:
        return (i > 0) & _is_ancestor(F.get(entries, i - 1)["path"], e["path"])

    any_conflict = F.exists(F.transform(entries, neighbour_conflict), lambda x: x)

    def survives(e: Column) -> Column:
        replaced_by_scalar = F.exists(
            entries,
            lambda q: _is_ancestor(q["path"], e["path"])
            & F.coalesce(q["scalar_seq"] > e["seq"], F.lit(False)),
        )
        empty_object = e["json"] == "{}"
        has_live_child = F.exists(
            entries,
            lambda q: _is_ancestor(e["path"], q["path"])
            & F.when(
                empty_object,
                F.coalesce(q["seq"] > e["scalar_seq"], F.lit(True)),
            ).otherwise(q["seq"] > e["seq"]),
        )
        return ~replaced_by_scalar & ~has_live_child

    return F.when(any_conflict, F.filter(entries, survives)).otherwise(entries)


def tombstones(ids: DataFrame, seq: Column) -> DataFrame:
    """Delete operations for the given keys (delete by id or by query)."""
    return ids.select(
        "*", F.lit("delete").alias("op"), seq.alias("seq"), F.lit(None).cast("variant").alias("body")
    )


def live_without(docs: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents that remain after a delete by query."""
    return docs.join(doomed.select(*keys).distinct(), list(keys), "left_anti")
