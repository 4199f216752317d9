"""Text search over an inverted index of exact TF-IDF weights."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rows import each
from ..session import small_batches, written
from .joins import lookup_join
from .onlinelda import bags as bags_of_hashes
from .words import bag_of_words, with_bags

# what tasks call travels with them, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bags(docs: DataFrame, key: str, words: str) -> DataFrame:
    """``key, word, tf``: the distinct words of each document with their counts, counted in its row."""
    return bag_of_words(docs, key, words).select(key, F.col("token").alias("word"), F.col("n").alias("tf"))


def idf(n_docs: Column | int, df: Column) -> Column:
    """Smoothed inverse document frequency: ``ln((n + 1) / (df + 1))``; a word of every document weighs nothing."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log((n.cast("double") + 1) / (df + 1))


def with_lengths(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``docs`` with the ``length`` of their TF-IDF weights, computed in their rows.

    Of ``words(word, idf)`` each task gets a hash and a number, so the rows of all words of all documents need not move.
    """
    spark = docs.sparkSession
    table = words.select(F.xxhash64("word").alias("hash"), "idf").toArrow()
    order = np.argsort(table.column("hash").to_numpy())
    weights = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("hash", "idf")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = weights.value
        for batch in batches:
            _, owner, place, n = bags_of_hashes(batch, known)
            length = np.sqrt(np.bincount(owner, (n * idf[place]) ** 2, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(length)], names=[*batch.schema.names[:-1], "length"])

    small_batches(spark)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    return docs.select("*", hashes).mapInArrow(measure, f"{kept}, length double")


class TextIndex:
    """Posting rows ``word, key, tf, length`` (of the document), and ``word, idf``.

    Both are written tables. Postings lie in the parts of their documents, sorted by (word, key): a search for few words opens
    few row groups of each, and sums nearly all of a document's products where they are read. The word's weight comes with the question.
    """

    def __init__(self, docs: DataFrame, key: str, words: str):
        self.key = key
        docs = written(docs.select(key, F.col(words).alias("words")), "index-words")
        total = docs.count()
        found = each(docs, [], F.array_distinct("words"), "word").groupBy("word").agg(F.count("*").alias("df"))
        self.words = written(found.select("word", idf(total, F.col("df")).alias("idf")), "idf")
        measured = with_lengths(docs.where(F.col(key).isNotNull()), self.words).where("length > 0")
        # rows that share a key are one document with one length; there are few, so they alone are looked for again
        repeated = written(docs.groupBy(key).count().where("count > 1").select(key), "repeated")
        if repeated.head(1):
            joint = lookup_join(measured, repeated, [key], "left_semi").groupBy(key).agg(F.sqrt(F.sum(F.col("length") * F.col("length"))).alias("joint"))
            measured = lookup_join(measured, written(joint, "joint"), [key], "left").withColumn("length", F.coalesce("joint", "length")).drop("joint")
        measured = with_bags(measured, "words")
        rows = each(measured, [key, "length"], F.col("bag"), "b").select(F.col("b.token").alias("word"), key, F.col("b.n").alias("tf"), "length")
        self.postings = written(rows.sortWithinPartitions("word", key), "postings")

    def search(self, queries: DataFrame, query_key: str, words: str, k: int) -> DataFrame:
        """``query_key, rank, key, score``: the ``k`` documents with the greatest cosine to each query text.

        Only documents that share a weighty word with a query are scored, from the postings of its words. Words the
        index does not know add to no score and no length. Ties at six decimals go to the smaller key.
        """
        asked = bags(queries, query_key, words).join(self.words, "word").select(query_key, "word", "idf", (F.col("tf") * F.col("idf")).alias("w"))
        asked = written(asked.where("w > 0"), "asked")
        length = asked.groupBy(query_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
        met = lookup_join(self.postings.withColumnRenamed("tf", "__tf"), asked, ["word"])
        weight = F.col("__tf") * F.col("idf") / F.col("length")
        dots = met.groupBy(query_key, self.key).agg(F.sum(weight * F.col("w")).alias("dot"))
        scored = lookup_join(dots, length, [query_key]).select(query_key, self.key, F.round(F.col("dot") / F.col("length"), 6).alias("score"))
        order = Window.partitionBy(query_key).orderBy(F.desc("score"), self.key)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, "rank", self.key, "score")
