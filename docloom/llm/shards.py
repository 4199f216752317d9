"""Shards that all hold the same mixture of sources: proportional stratified interleaving.

DataFrame functions only. Rows are shuffled by a seeded hash and ranked within their source; the
rank divided by the source's size says where in the whole a row belongs; ordered by that fraction the
sources are interleaved in proportion, and any stretch of the order has the mixture of the whole. The shards
are equal stretches. Texts are read once, for their size and hash; only these slim rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ranks import group_text, ranked

#: Bytes that a stored record has besides its text.
HEADER = 16


def interleaved(
    docs: DataFrame, shards: int = 40, seed: str = "mixture", key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``id, source, size, text_crc32, shard, slot`` of every row of ``docs``, and the columns ``carry``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. The numbers of rows of two shards differ by at most one, and those
    of one source in two shards by little more; slots count from 0 without gaps. Rows whose source is null are a
    source of their own, as are those with an empty one. The order depends on seed, id and text alone: rows that agree
    in both are dealt one by one and may be exchanged for each other. Null ids, ties and repeated rows are dealt like
    others. With fewer rows than shards some shards stay empty; an empty table gives no rows. Other columns are not read.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"),
        (F.octet_length(raw) + HEADER).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *carry,
    )
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    rows = written(rows.select("*", group_text("source").alias("stratum"), drawn.alias("drawn")), "sizes")
    within = ranked(rows, "stratum", ["drawn", "id"], rank="r", size="n")
    fraction = (F.col("r") * 2 + 1) / (F.col("n") * 2)
    spot = written(within.select("id", "source", "size", "text_crc32", *carry, "stratum", fraction.alias("fraction"), F.lit("").alias("whole")), "fractions")
    placed = ranked(spot, "whole", ["fraction", "stratum"], rank="pos", size="total")
    shard = F.expr(f"pos * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard)
    return out.select("id", "source", "size", "text_crc32", *carry, F.col("shard").cast("int").alias("shard"), (F.col("pos") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, **names: str) -> DataFrame:
    """Write all columns of ``docs`` below ``path/__shard=<n>`` in slot order, and return what was written.

    The rows are written once with a number of their own; only their slim forms are ranked, and the texts move once to
    meet their place and once into their shard. A shard larger than a partition has several files, in order of their names.
    """
    spark = docs.sparkSession
    whole = written(docs.withColumn("__number", F.monotonically_increasing_id()), "numbered")
    place = interleaved(whole, shards, carry=("__number",), **names).select("__number", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    out = whole.join(place, "__number").drop("__number")
    out.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)
    return spark.read.parquet(path)


def shards_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The shards under the law that their numbers of rows differ by at most one."""
    found = interleaved(docs, shards)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
