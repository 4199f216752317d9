"""Questions between blocks of documents and buckets of hashes.

Documents are dealt into blocks of bounded size. A block sends each bucket its distinct hashes
once, sorted and packed; the bucket merges what all blocks sent and answers each block in the
order of its question. A value found in every document thus costs one entry a block, never one
an occurrence, and no group of documents has to meet in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import give_back, in_small_batches

#: Text bytes a block holds on average, and hashes a bucket is sized for.
BLOCK_BYTES, BUCKET_HASHES = 4 << 20, 400_000
ASKED = "bucket int, block int, question binary"
ANSWERED = "block int, bucket int, answer binary"


def text_blocks(docs: DataFrame, key: str, text: str = "text", block_bytes: int | None = None, extra=()) -> tuple[DataFrame, int, int]:
    """Rows ``block, row_key, doc, text`` and the numbers of blocks and text bytes.

    ``row_key`` hashes key and text, so rows with a null or repeated key spread over blocks as
    well; equal rows are interchangeable.
    """
    rows = in_small_batches(docs).select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), *extra)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / (block_bytes or BLOCK_BYTES)))
    keyed = rows.withColumn("row_key", F.xxhash64("doc", "text"))
    return keyed.withColumn("block", F.pmod(F.hash("row_key"), F.lit(n)).cast("int")), n, size


def ordered(block: pa.Table) -> pa.Table:
    """The rows of a block in the one order that all passes over it use."""
    return block.take(pa.array(np.argsort(block.column("row_key").to_numpy(), kind="stable")))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers from the upper 32 bits, rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split(sorted_hashes: np.ndarray, buckets: int):
    """``(bucket, from, to)`` for each bucket that occurs among sorted hashes."""
    of = bucket_of(sorted_hashes, buckets)
    cut = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
    return [(int(of[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if b > a]


def questions(block: int, parts) -> pa.Table:
    parts = list(parts)
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in parts], pa.int32()),
            "block": pa.array([block] * len(parts), pa.int32()),
            "question": pa.array([q for _, q in parts], pa.binary()),
        }
    )


def answers(table: pa.Table, parts) -> pa.Table:
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "answer": pa.array(list(parts), pa.binary()),
        }
    )


def counted(n: int) -> bytes:
    return np.uint32(n).tobytes()


def count_of(data: bytes) -> int:
    return int(np.frombuffer(data, np.uint32, 1)[0])


def by_bucket(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist()))


def returning(work):
    """``work`` on tables, giving memory back after each."""

    def run(*tables: pa.Table) -> pa.Table:
        found = work(*tables)
        give_back()
        return found

    return run


def ask(blocks: DataFrame, question) -> DataFrame:
    return blocks.groupBy("block").applyInArrow(lambda rows: returning(question)(rows), ASKED)


def answer(asked: DataFrame, reply) -> DataFrame:
    return asked.groupBy("bucket").applyInArrow(lambda rows: returning(reply)(rows), ANSWERED)


def told(blocks: DataFrame, answered: DataFrame, use, schema: str) -> DataFrame:
    """``use(rows of a block, answers to it)`` for every block of documents."""
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(lambda rows, told: returning(use)(rows, told), schema)
