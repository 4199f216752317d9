"""Hard negatives by the threshold algorithm.

Rows are ordered by label and cut into blocks. A block sorts its rows once per dimension. For an anchor,
each list is read from the end that its sign favours, all lists to the same depth; a row is scored at first sight, in
integers, from its whole vector. What the lists show at that depth bounds the score of every row not yet seen, so an
anchor stops as soon as the bound lies strictly below the kth score of each window it fills. Positives come first,
from the blocks of the anchor's label; each sets a window of scores, and the negatives are the best rows within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import written
from .ranks import ranked

#: Rows of a block, anchors of a group, anchors whose scores are held at once, and the first depth read.
BLOCK, GROUP, BATCH, DEPTH = 4096, 4096, 128, 16
LONG = (1 << 63) - 1
WINDOWS = "array<struct<w:int,id:bigint,score:bigint>>"
FOUND = "anchor long, anchor_id long, w int, positive_id long, positive_score long, other long, other_id long, score long"
NONE = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in FOUND.split(", ")])


def usable_rows(table: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    good = (
        F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 1e305))
    )
    floored = F.transform(vector, lambda x: x.cast("double"))
    rows = table.where(good).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), floored.alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = np.floor(256 * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = 8 * np.r_[0, np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False))]
            data = pa.Array.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), data.cast(pa.binary())], ["id", "label", "v"])

    return rows.mapInArrow(packed, "id long, label long, v binary")


def matrix(column) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every sum of products is exact in them, else as Python integers."""
    if a.size == 0 or c.size == 0 or np.abs(a).max() * np.abs(c).max() * a.shape[1] < 2.0**53:
        return a, c
    whole = np.frompyfunc(int, 1, 1)
    return whole(a), whole(c)


class Lists:
    """Per-dimension sorted lists of a block's rows."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, self.order, axis=0)

    def bound(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """Greatest score that a row not among the first ``depth`` of any list can have, for each anchor."""
        top, low = self.sorted[len(self.rows) - depth], self.sorted[depth - 1]
        up = np.where(anchors > 0, anchors, 0)
        return up @ top + (anchors - up) @ low

    def seen(self, anchor: np.ndarray, depth: int) -> np.ndarray:
        """Rows within ``depth`` of the end that the anchor's sign favours, in any list whose dimension it uses."""
        marks = np.zeros(len(self.rows), bool)
        marks[self.order[len(self.rows) - depth :, anchor > 0].ravel()] = True
        marks[self.order[:depth, anchor < 0].ravel()] = True
        return marks


def searched(lists: Lists, anchors: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """The best ``k`` allowed rows of each window: anchor, window, row and score of each.

    ``low``/``high``: bounds of the windows of each anchor (anchors x windows; a window with low > high is void); the
    rows of a block ascend by id, so equal scores are taken in their order.
    """
    n = len(lists.rows)
    out = []
    for at in range(0, len(anchors), BATCH):
        a, ok = anchors[at : at + BATCH], allowed[at : at + BATCH]
        lo, hi = low[at : at + BATCH], high[at : at + BATCH]
        scores = np.full((len(a), n), -np.inf, a.dtype)
        met = np.zeros((len(a), n), bool)
        active, depth = np.flatnonzero((lo <= hi).any(1)), min(DEPTH, n)
        kth = np.full(lo.shape, -np.inf, a.dtype)
        while len(active):
            for i in active:
                # an anchor of zeros uses no list: all its scores are zero and equally good
                new = np.flatnonzero(lists.seen(a[i], depth) & ~met[i]) if a[i].any() and depth < n else np.flatnonzero(~met[i])
                met[i, new] = True
                new = new[ok[i, new]]
                scores[i, new] = lists.rows[new] @ a[i]
            for w in range(lo.shape[1]):
                s = scores[active]
                s = np.where((s >= lo[active, w, None]) & (s <= hi[active, w, None]), s, -np.inf)
                kth[active, w] = np.partition(s, n - k, axis=1)[:, n - k] if n >= k else -np.inf
            if depth == n:
                break
            void = lo[active] > hi[active]
            # below a window's lower end nothing can enter it either
            stop = void | (lists.bound(a[active], depth)[:, None] < np.maximum(kth[active], lo[active]))
            active, depth = active[~stop.all(1)], min(2 * depth, n)
        for w in range(lo.shape[1]):
            inside = (scores >= np.maximum(kth[:, w], lo[:, w])[:, None]) & (scores <= hi[:, w, None]) & (scores > -np.inf)
            i, row = np.nonzero(inside)
            s = scores[i, row]
            by = np.lexsort((row, -np.unique(s, return_inverse=True)[1], i))
            i, row, s = i[by], row[by], s[by]
            first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            i, row, s = i[place < k], row[place < k], s[place < k]
            out.append((i + at, np.full(len(i), w), row, s))
    return [np.concatenate(x) for x in zip(*out)]


def long_array(values) -> pa.Array:
    if values.dtype == object:
        return pa.array([max(-LONG - 1, min(LONG, int(x))) for x in values], pa.int64())
    return pa.array(values.astype(np.int64))


def block_search(rows: pa.Table, k: int, same: bool, window: tuple[int, int, int] | None) -> pa.Table:
    """Answers of one block to one group of anchors; vectors of different lengths do not meet."""
    rows = rows.combine_chunks()
    asked = np.asarray(rows.column("asked"))
    length = pc.binary_length(rows.column("v").combine_chunks()).to_numpy(zero_copy_only=False)
    parts = []
    for n in np.unique(length[asked]):
        left, right = (rows.take(np.flatnonzero((length == n) & side)) for side in (asked, ~asked))
        if not len(left) or not len(right):
            continue
        right = right.sort_by([("id", "ascending"), ("pos", "ascending")])
        a, c = exact(matrix(left.column("v")), matrix(right.column("v")))
        la, lc = left.column("label").to_numpy(), right.column("label").to_numpy()
        allowed = (la[:, None] == lc) == same
        if same:
            allowed &= left.column("pos").to_numpy()[:, None] != right.column("pos").to_numpy()
            low, high = np.full((len(a), 1), -np.inf), np.full((len(a), 1), np.inf)
        else:
            wins = left.column("wins").to_pylist()
            most = max(len(w) for w in wins)
            scale, least, top = window
            low, high = np.full((len(a), most), 1, a.dtype), np.full((len(a), most), 0, a.dtype)
            for i, ws in enumerate(wins):
                for j, w in enumerate(ws):
                    low[i, j], high[i, j] = -(-least * w["score"] // scale), top * w["score"] // scale
        i, w, row, s = searched(Lists(c), a, allowed, low, high, k)
        i, row = i.astype(int), row.astype(int)
        got = {"anchor": left.column("pos").take(i), "anchor_id": left.column("id").take(i), "w": pa.array(w.astype(np.int32))}
        if same:
            got |= {"positive_id": pa.nulls(len(i), pa.int64()), "positive_score": pa.nulls(len(i), pa.int64())}
        else:
            pick = [wins[x][y] for x, y in zip(i, w.astype(int))]
            got |= {"positive_id": pa.array([p["id"] for p in pick], pa.int64()), "positive_score": pa.array([p["score"] for p in pick], pa.int64())}
        got |= {"other": right.column("pos").take(row), "other_id": right.column("id").take(row), "score": long_array(s)}
        parts.append(pa.table(got).cast(NONE))
    return pa.concat_tables(parts) if parts else NONE.empty_table()


def best(found: DataFrame, k: int) -> DataFrame:
    """Of all blocks' answers the best ``k`` per window, numbered from 1; each task first keeps its own best."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame,
    anchors: Column,
    label: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int, int] = (100, 30, 90),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows where ``anchors`` holds.

    ``anchors`` is a condition on the key column (called ``id`` in it). Scores are inner products of the components' ``floor(256 * x)``; higher ones
    come first, of equal ones the smaller key. An anchor's positives are its first other rows with the same
    label; the negatives of each are the first rows of other labels with ``window[1] * p <= window[0] * n <= window[2] * p``. A positive
    without such rows, or with a score below zero, gives none. Rows whose key, label or vector is null, or whose vector has a null or
    non-finite component, take no part. Vectors of different lengths do not meet. Rows that repeat a key are rows of their own,
    each an anchor. Scores that leave 64 bits are exact in comparisons and clipped in the output. An empty
    table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    rows = written(usable_rows(table, key, vector, label), "vectors").withColumn("whole", F.lit(""))
    rows = written(ranked(rows, "whole", ["label", "id"], rank="pos").withColumn("block", F.expr(f"pos div {BLOCK}").cast("int")), "blocks")
    chosen = rows.where(anchors)
    last, asking = rows.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0], chosen.count()
    groups = max(1, -(-asking // GROUP))
    group = F.pmod(F.xxhash64("pos"), F.lit(groups)).cast("int").alias("g")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    plain = ["pos", "id", "label", "v", "block", "g"]
    right = rows.select("*", every(groups).alias("g")).select(*plain, F.lit(False).alias("asked"), F.lit(None).cast(WINDOWS).alias("wins"))
    chosen = chosen.select("pos", "id", "label", "v", group)

    # the blocks that hold a label are those from its first to its last
    homes = rows.groupBy("label").agg(F.sequence(F.min("block"), F.max("block")).alias("homes"))
    near = lookup_join(chosen, homes, ["label"]).withColumn("block", F.explode("homes"))
    near = near.select(*plain, F.lit(True).alias("asked"), F.lit(None).cast(WINDOWS).alias("wins"))
    found = right.unionByName(near).groupBy("block", "g").applyInArrow(lambda t: block_search(t, positives, True, None), FOUND)
    found = written(best(found, positives), "positives")
    wins = found.where("score >= 0").groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("w"), F.col("other_id").alias("id"), "score"))).alias("wins")
    )
    asked = chosen.join(wins, F.col("pos") == F.col("anchor")).select("pos", "id", "label", "v", "g", "wins")
    far = asked.select("*", every(last + 1).alias("block")) if last >= 0 else asked.withColumn("block", F.lit(0))
    far = far.select(*plain, F.lit(True).alias("asked"), "wins")
    met = right.unionByName(far).groupBy("block", "g").applyInArrow(lambda t: block_search(t, negatives, False, window), FOUND)
    return best(met, negatives).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def negatives_digest(table: DataFrame) -> DataFrame:
    """Anchors are rows whose id is divisible by 100; where it is divisible by 7, the label moves on by one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table, F.col("id") % 100 == 0, label)
