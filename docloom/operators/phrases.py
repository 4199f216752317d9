"""Two-word phrases: counting, scoring and greedy merging."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import each
from ..session import small_batches, written
from .joins import lookup_join

# what tasks call travels with them, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Default support and score a phrase needs.
MIN_COUNT = 5
THRESHOLD = 100.0


def neighbour_pairs(token_list: Column) -> Column:
    """``array<struct<a, b>>`` of adjacent tokens."""
    return F.when(
        F.size(token_list) > 1,
        F.zip_with(
            F.slice(token_list, F.lit(1), F.size(token_list) - 1),
            F.slice(token_list, F.lit(2), F.size(token_list) - 1),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        ),
    )


def scored_pairs(
    docs: DataFrame, token_col: str, min_count: int = MIN_COUNT, threshold: float = THRESHOLD
) -> DataFrame:
    """Pairs above the threshold: ``a, b, n_ab, n_a, n_b, score``.

    ``score = (n_ab - min_count) * vocabulary / (n_a * n_b)`` with the vocabulary counting
    distinct words and distinct pairs. Only pairs above the support can score above zero, so
    rare pairs are dropped before the joins.
    """
    # every token once, with its follower; behind the last token that is null
    follower = F.slice(token_col, F.lit(2), F.greatest(F.size(token_col), F.lit(1)))
    spots = each(docs, [], F.arrays_zip(F.col(token_col).alias("a"), follower.alias("b")), "p")
    # words and pairs are counted in one pass and one shuffle
    counts = written(spots.groupBy("p.a", "p.b").agg(F.count("*").alias("n")), "pair-counts")
    words = written(
        counts.groupBy("a").agg(F.sum("n").alias("n"), F.count("b").alias("pairs")), "word-counts"
    )
    sizes = words.agg(F.count("*"), F.sum("pairs")).first()
    vocabulary = sizes[0] + (sizes[1] or 0)
    frequent = counts.filter(F.col("b").isNotNull() & (F.col("n") > min_count)).select(
        "a", "b", F.col("n").alias("n_ab")
    )
    # a word is at least as frequent as its pairs
    words = words.filter(F.col("n") > min_count)
    first = words.select("a", F.col("n").alias("n_a"))
    second = words.select(F.col("a").alias("b"), F.col("n").alias("n_b"))
    joined = lookup_join(lookup_join(frequent, first, ["a"]), second, ["b"])
    score = (F.col("n_ab") - min_count) * F.lit(vocabulary) / (F.col("n_a") * F.col("n_b"))
    found = joined.select("a", "b", "n_ab", "n_a", "n_b", score.alias("score"))
    return written(found.filter(F.col("score") > threshold), "phrases")


def greedy_starts(starts: Column) -> Column:
    """Start positions taken from left to right; the second word of a phrase cannot start one."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        F.array_sort(F.coalesce(starts, none)),
        F.struct(F.lit(-1).alias("last"), none.alias("taken")),
        lambda acc, p: F.when(
            p > acc["last"] + 1,
            F.struct(p.alias("last"), F.array_append(acc["taken"], p).alias("taken")),
        ).otherwise(acc),
        lambda acc: acc["taken"],
    )


def merge_at(token_list: str, taken: str) -> Column:
    """Join the tokens at the taken 1-based positions with their successors.

    The list is cut at each phrase, so the work grows with the tokens and not with tokens times
    phrases: the piece before a phrase, the phrase, and after the last one the rest.
    """
    words, at = F.col(token_list), F.col(taken)
    pieces = F.transform(
        at,
        lambda p, i: F.concat(
            F.slice(
                words,
                F.when(i > 0, F.get(at, i - 1) + 2).otherwise(1),
                p - F.when(i > 0, F.get(at, i - 1) + 2).otherwise(1),
            ),
            F.array(F.concat(F.get(words, p - 1), F.lit("_"), F.get(words, p))),
        ),
    )
    begin = F.try_element_at(at, F.lit(-1)) + 2
    rest = F.slice(words, begin, F.greatest(F.size(words) - begin + 1, F.lit(0)))
    return F.when(F.size(at) > 0, F.concat(F.flatten(pieces), rest)).otherwise(words)


def phrase_starts(docs: DataFrame, token_col: str, phrases: DataFrame, name: str) -> DataFrame:
    """``docs`` with the 1-based positions at which a phrase starts.

    Each task gets two hashes of every phrase (96 bits that a pair has to meet) and looks the pairs of a text up in its row, so no
    position moves.
    """
    spark = docs.sparkSession
    hashes = lambda a, b: (F.xxhash64(a, b), F.hash(b, a).cast("long"))
    table = phrases.select(*[h.alias(c) for h, c in zip(hashes("a", "b"), "ab")]).distinct().toArrow()
    order = np.argsort(table.column("a").to_numpy())
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in "ab"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = known.value
        for batch in batches:
            pairs = batch.column(batch.num_columns - 1)
            sizes = np.nan_to_num(pairs.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = pairs.flatten()
            at = np.searchsorted(first, flat.field("x").to_numpy())
            at[at == len(first)] = 0
            hit = np.flatnonzero((first[at] == flat.field("x").to_numpy()) & (second[at] == flat.field("y").to_numpy())) if len(first) else np.zeros(0, int)
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, hit, side="right")
            cuts = np.searchsorted(hit, np.concatenate([[0], ends])).astype(np.int32)
            starts = pa.ListArray.from_arrays(pa.array(cuts), pa.array((hit - (ends - sizes)[row] + 1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], starts], names=[*batch.schema.names[:-1], name])

    small_batches(spark)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    pairs = F.transform(neighbour_pairs(F.col(token_col)), lambda p: F.struct(*[h.alias(c) for h, c in zip(hashes(p["a"], p["b"]), "xy")]))
    return docs.select("*", pairs.alias("__pairs")).mapInArrow(find, f"{kept}, {name} array<int>")


def apply_phrases(docs: DataFrame, key: str, token_col: str, phrases: DataFrame) -> DataFrame:
    """Documents with ``token_col`` merged, each in its row; rows may share a key."""
    found = phrase_starts(docs, token_col, phrases, "__starts")
    return (
        found.withColumn("__taken", greedy_starts(F.col("__starts")))
        .withColumn(token_col, merge_at(token_col, "__taken"))
        .drop("__starts", "__taken")
    )
