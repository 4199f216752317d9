"""Benchmark passages in documents, by winnowing; DataFrame functions only.

From every run of ``window`` words winnowing keeps the least hash of its k-grams. Two texts that
share a run keep the same hash of it, so every shared run is found by joining the kept hashes of
documents and benchmark items. Hits are extended to whole windows by comparing all word windows of
the documents found with those of the items, by two independent 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of two longs that are broadcast at most; a larger benchmark is joined by shuffling.
BROADCAST_ROWS = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """A to Z lowered; other letters stay as they are."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often lambdas look into it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def over(last: Column, make) -> Column:
    """``make(i)`` for i from 0 to ``last``; nothing below 0."""
    made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), make)
    return F.when(last >= 0, made).otherwise(F.array().cast("array<long>"))


def runs(hashes: Column, length: int, *salt) -> Column:
    """Hashes of all runs of ``length`` elements; empty for shorter arrays."""
    one = lambda h, i: F.xxhash64(*salt, *(F.get(h, i + k) for k in range(length)))
    return let(hashes, lambda h: over(F.size(h) - length, lambda i: one(h, i)))


def minima(hashes: Column, width: int) -> Column:
    """Distinct least values of all runs of ``width`` elements; empty for shorter arrays."""
    one = lambda h, i: F.least(*(F.get(h, i + k) for k in range(width)))
    return F.array_distinct(let(hashes, lambda h: over(F.size(h) - width, lambda i: one(h, i))))


def small(side: DataFrame) -> DataFrame:
    """Marked for broadcast if it is counted to be small."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 10, gram: int = 5,
) -> DataFrame:
    """``doc, n_words, hits, items`` of every row of ``docs``: sorted ``(start, length)`` of the windows found, and item ids.

    Words are lower-cased (A to Z) runs of letters, digits and characters beyond ASCII. A window is
    ``window`` consecutive words of an item; a shorter item is one window itself, an item without words
    has none. Null texts have no words. Items with a null id mark words but are not listed. Rows with
    null or repeated keys are judged by their own text; empty tables on either side give no hits; other
    columns are not read.
    """
    width = window - gram + 1
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc", "text"))
    hashed = rows.select("row_key", word_hashes(words_of(F.col("text"))).alias("h"))
    items = benchmark.select(F.col(item).alias("item"), word_hashes(words_of(F.col(item_text))).alias("h"))
    items = items.where(F.size("h") > 0)
    lengths = [r[0] for r in items.where(F.size("h") < window).select(F.size("h")).distinct().orderBy(F.size("h")).collect()]

    def exploded(source: DataFrame, *columns: str, length: int) -> DataFrame:
        """Every run of a text: where it starts and two hashes of it."""
        both = F.arrays_zip(runs(F.col("h"), length).alias("a"), runs(F.col("h"), length, F.lit(1)).alias("b"))
        made = source.select(*columns, F.posexplode(both).alias("start", "run"))
        return made.select(*columns, "start", F.lit(length).alias("length"), F.col("run.a"), F.col("run.b"))

    long_items = items.where(F.size("h") >= window)
    kept = long_items.select(F.explode(minima(runs(F.col("h"), gram), width)).alias("mark")).distinct()
    marks = hashed.select("row_key", F.explode(minima(runs(F.col("h"), gram), width)).alias("mark"))
    suspects = marks.join(small(kept), "mark", "left_semi").select("row_key", F.lit(window).alias("length"))
    for m in lengths:  # each short item is looked for as a whole
        whole = items.where(F.size("h") == m).select(F.explode(runs(F.col("h"), m)).alias("mark")).distinct()
        found = hashed.select("row_key", F.explode(runs(F.col("h"), m)).alias("mark")).join(small(whole), "mark", "left_semi")
        suspects = suspects.unionByName(found.select("row_key", F.lit(m).alias("length")))
    suspects = suspects.groupBy("row_key").agg(F.collect_set("length").alias("lengths"))

    again = hashed.join(suspects, "row_key")
    found = None
    for m in [*lengths, window]:
        pieces = exploded(items.where(F.size("h") == m) if m < window else long_items, "item", length=m)
        windows = small(pieces.select("item", "a", "b").distinct())
        own = exploded(again.where(F.array_contains("lengths", m)), "row_key", length=m)
        hit = own.join(windows, ["a", "b"]).select("row_key", "start", "length", "item")
        found = hit if found is None else found.unionByName(hit)
    by_row = found.groupBy("row_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    counted = rows.select("doc", "row_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(by_row, "row_key", "left").select(
        "doc",
        "row_key",
        "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def hit_words(hits: Column) -> Column:
    """Number of words that lie in any of the sorted ``(start, length)`` runs."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["end"], x["start"]))).alias("n"),
        F.greatest(acc["end"], x["start"] + x["length"]).alias("end"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(hits, zero, step, lambda acc: acc["n"]).cast("long")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
