"""Vocabulary, bag of words and lexicon lookups on token lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rows import each
from ..session import written
from .joins import lookup_join


def with_bags(docs: DataFrame, token_col: str, name: str = "bag") -> DataFrame:
    """Adds ``array<struct<token,n>>`` per row.

    All tokens of a document are in its row, so counting is done in place: sort, mark where runs
    begin, take differences. Nothing is shuffled.
    """
    ordered = docs.withColumn("__sorted", F.sort_array(F.col(token_col)))
    marked = ordered.withColumn(
        "__begin",
        F.array_compact(
            F.transform(
                "__sorted",
                lambda t, i: F.when((i == 0) | (F.get("__sorted", i - 1) != t), i),
            )
        ),
    )
    counted = F.transform(
        "__begin",
        lambda at, k: F.struct(
            F.get("__sorted", at).alias("token"),
            (F.coalesce(F.get("__begin", k + 1), F.size("__sorted")) - at).cast("long").alias("n"),
        ),
    )
    return marked.withColumn(name, counted).drop("__sorted", "__begin")


def bag_of_words(docs: DataFrame, key: str, token_col: str) -> DataFrame:
    """``key, token, n`` per document (one row per document comes in)."""
    bags = with_bags(docs.select(key, F.col(token_col).alias("__tokens")), "__tokens")
    return each(bags, [key], F.col("bag"), "b").select(key, "b.*")


def dense_ids(values: DataFrame, column: str, name: str = "token_id", keep: Sequence[str] = ()) -> DataFrame:
    """Consecutive ids from 0 in value order, without a single-task window.

    The distinct values are written, range-partitioned and written again with their partition
    number; then each partition ranks its own rows and adds the number of rows in lower
    partitions. Range partitioning samples its input, which therefore must be cheap to read.
    With columns to ``keep`` the values must be distinct already.
    """
    distinct = written(values.select(column, *keep) if keep else values.select(column).distinct(), "distinct")
    ranged = written(
        distinct.repartitionByRange(F.col(column)).withColumn("__part", F.spark_partition_id()),
        "dense-ids",
    )
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row per partition of the written table, a few thousand at most
    lower = sizes.select(
        "__part",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__offset"),
    )
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return (
        ranged.join(F.broadcast(lower), "__part")
        .select(column, *keep, (rank + F.col("__offset") - 1).alias(name))
    )


def dictionary_bags(docs: DataFrame, key: str, token_col: str) -> tuple[DataFrame, DataFrame]:
    """Dictionary ``token, token_id`` and corpus ``key, token_id, n``.

    Only the vocabulary is shuffled and written; bags are counted in place and looked up.
    """
    vocabulary = each(docs, [], F.array_distinct(token_col), "token")
    ids = written(dense_ids(vocabulary, "token"), "dictionary")
    corpus = lookup_join(bag_of_words(docs, key, token_col), ids, ["token"])
    return ids, corpus.select(key, "token_id", "n")


def dictionary_counts(docs: DataFrame, key: str, token_col: str) -> DataFrame:
    """Dictionary with its totals: ``token, n_docs, n, token_id``.

    Tokens are counted before they are numbered, so nothing but one row per token and task is shuffled and nothing is looked up.
    """
    bags = bag_of_words(docs, key, token_col)
    totals = bags.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))
    return dense_ids(totals, "token", keep=["n_docs", "n"])


def lemmatize(
    docs: DataFrame,
    key: str,
    token_col: str,
    lexicon: DataFrame,
    keep_pos: Sequence[str] = ("NOUN", "ADJ", "VERB", "ADV"),
    stop: Sequence[str] = (),
) -> DataFrame:
    """Replace tokens by their lemma and keep some parts of speech: ``key, pos, lemma``.

    ``lexicon`` has ``word, lemma, pos``; words it does not know are kept as they are.
    """
    spots = each(docs, [key], F.col(token_col), "word", at="position")
    return _tagged(spots, lexicon, keep_pos, stop).select(key, "position", "lemma")


def _tagged(rows: DataFrame, lexicon: DataFrame, keep_pos: Sequence[str], stop: Sequence[str]) -> DataFrame:
    """Rows of a ``word`` with the ``lemma`` of every lexicon entry that is kept, its own word without one."""
    tagged = lookup_join(rows, lexicon.select("word", "lemma", "pos"), ["word"], "left")
    tagged = tagged.filter(F.col("pos").isNull() | F.col("pos").isin(list(keep_pos)))
    tagged = tagged.withColumn("lemma", F.coalesce("lemma", "word")).drop("pos")
    return tagged.filter(~F.col("lemma").isin(sorted(set(stop)))) if stop else tagged


def lemma_totals(
    docs: DataFrame,
    key: str,
    token_col: str,
    lexicon: DataFrame,
    keep_pos: Sequence[str] = ("NOUN", "ADJ", "VERB", "ADV"),
    stop: Sequence[str] = (),
) -> DataFrame:
    """Totals of ``lemmatize``: ``lemma, n, n_docs, places`` (``places`` sums the positions).

    Words are counted before they are looked up, so one row per word and task is shuffled. Only
    lemmas that several words or lexicon entries can give need the keys of their documents told apart; for all
    others the documents of the word are counted. ``docs`` is read several times.
    """
    lexicon = written(lexicon.select("word", "lemma", "pos"), "lexicon")
    spots = each(docs, [], F.col(token_col), "word", at="position")
    places = spots.groupBy("word").agg(F.count("*").alias("n"), F.sum(F.col("position").cast("long")).alias("places"))
    moved = lexicon.filter(F.col("lemma") != F.col("word"))
    several = lexicon.groupBy("word").count().filter("count > 1")
    shared = written(
        moved.select("word").union(moved.select("lemma")).union(several.select("word")).distinct(), "shared-words"
    )
    keys = docs.agg(F.count(key), F.count_distinct(key)).first()
    holders = each(docs, [key], F.array_distinct(token_col), "word")
    n_docs = (F.count if keys[0] == keys[1] else F.count_distinct)(key).alias("n_docs")
    alone = lookup_join(holders.groupBy("word").agg(n_docs), shared, ["word"], "left_anti")
    none = F.lit(0).cast("long")
    counts = places.withColumn("n_docs", none).unionByName(alone.withColumns({"n": none, "places": none}))
    lemmas = _tagged(shared, lexicon, keep_pos, stop).select("word", "lemma").distinct()
    joint = lookup_join(holders, lemmas, ["word"]).groupBy("lemma").agg(F.count_distinct(key).alias("n_docs"))
    columns = ["lemma", "n", "n_docs", "places"]
    every = _tagged(counts, lexicon, keep_pos, stop).select(columns).union(joint.select("lemma", none, "n_docs", none))
    return every.groupBy("lemma").agg(*[F.sum(c).alias(c) for c in columns[1:]])


def top_terms(docs: DataFrame, key: str, token_col: str, k: int) -> DataFrame:
    """The ``k`` most frequent terms of each document: ``key, rank, term, n``; no shuffle."""
    bags = with_bags(docs.select(key, F.col(token_col).alias("__tokens")), "__tokens")
    ranked = F.sort_array(
        F.transform("bag", lambda e: F.struct((-e["n"]).alias("less"), e["token"].alias("term")))
    )
    return each(bags, [key], F.slice(ranked, 1, k), "e", at="at").select(
        key, (F.col("at") + 1).alias("rank"), "e.term", (-F.col("e.less")).alias("n")
    )
