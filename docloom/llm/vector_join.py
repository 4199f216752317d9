"""Exact join of vectors whose cosine reaches a threshold, per label.

On unit vectors a cosine is a distance, so this is a range join in a metric space with radius
``r = sqrt(2 - 2 cos)``. Pivots split the vectors of a label into cells of the nearest pivot. A vector
within ``r`` of a cell's border (by the triangle inequality and the distance to the plane between both
pivots) is copied to that cell, so each cell finds all partners of its own vectors by itself. Cells are
compared block by block, and a block returns counts and a spanning star for each group it sees,
never its pairs. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components

#: Vectors a cell is meant to hold, pivots in all (they are sent to every task), vectors of a block.
CELL, PIVOTS, BLOCK = 4000, 4096, 1500
PLACED = "label long, cell int, own boolean, rep long, weight long, vector binary"


def vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.float64) for x in column])


def usable(key: str, vector: str, label: str):
    return (
        F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(key).isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def unit_rows(rows: DataFrame) -> DataFrame:
    """One row ``label, v, least, weight, vector, rep`` for equal vectors of ``rows(label, id, v)``.

    ``vector`` has unit length, doubles as bytes; ``rep`` is a number of its own, since ids may repeat.
    """
    same = rows.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))

    def normal(batches):
        for batch in batches:
            out = []
            for x in batch.column("v"):
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                v = v / np.abs(v).max()
                out.append((v / np.sqrt(v @ v)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "vector"])

    found = same.mapInArrow(normal, f"label long, v {same.schema['v'].dataType.simpleString()}, least long, weight long, vector binary")
    return found.withColumn("rep", F.monotonically_increasing_id())


def chosen_pivots(units: DataFrame) -> dict:
    """Pivots of each label that needs several cells; at most about ``PIVOTS`` in all, by a hash of the vector's id."""
    sizes = {r[0]: r[1] for r in units.groupBy("label").count().where(F.col("count") > CELL).orderBy(F.desc("count")).limit(PIVOTS).collect()}
    share = min(1.0, PIVOTS * CELL / max(1, sum(sizes.values())))
    if not sizes:
        return {}
    drawn = units.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * share * 1.5 / CELL))
    out: dict = {}
    for row in drawn.orderBy(F.xxhash64("rep")).limit(2 * PIVOTS).collect():
        if row.label in sizes and len(out.setdefault(row.label, {})) * CELL < sizes[row.label]:
            out[row.label].setdefault(len(row.vector), []).append(np.frombuffer(row.vector))
    return {label: {n: np.stack(p) for n, p in by.items()} for label, by in out.items()}


def placed(units: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """Each vector in its own cell, and as a guest wherever a partner could live."""
    slack = 1e-9

    def place(batches):
        for batch in batches:
            labels = batch.column("label").to_pylist()
            own, guest = [], []
            for k, (label, raw) in enumerate(zip(labels, batch.column("vector"))):
                x = np.frombuffer(raw.as_py())
                p = pivots.get(label, {}).get(len(x) * 8)
                if p is None:
                    own.append((k, 0))
                    continue
                dots = p @ x
                home = int(dots.argmax())
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p[home]), 0))
                border = (dots[home] - dots) / np.maximum(apart, 1e-12)
                near = np.sqrt(np.maximum(2 - 2 * dots, 0)) - np.sqrt(max(2 - 2 * dots[home], 0)) <= 2 * radius + slack
                own.append((k, home))
                guest += [(k, int(c)) for c in np.flatnonzero((border <= radius + slack) & near) if c != home]
            for mark, found in ((True, own), (False, guest)):
                for a in range(0, len(found), 5000):
                    take = pa.array([k for k, _ in found[a : a + 5000]], pa.int64())
                    rows = pa.Table.from_batches([batch]).take(take)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("label").combine_chunks(), pa.array([c for _, c in found[a : a + 5000]], pa.int32()),
                            pa.array([mark] * len(take)), rows.column("rep").combine_chunks(),
                            rows.column("weight").combine_chunks(), rows.column("vector").combine_chunks(),
                        ],
                        ["label", "cell", "own", "rep", "weight", "vector"],
                    )

    return units.mapInArrow(place, PLACED)


def compared(rows: pa.Table, threshold: float) -> pa.Table:
    """Links of one block of a cell's own vectors with one block of all its vectors."""
    left, right = rows.filter(pc.equal(rows.column("side"), 0)), rows.filter(pc.equal(rows.column("side"), 1))
    empty = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if not len(left) or not len(right):
        return empty
    dims = sorted({len(x.as_py()) for x in left.column("vector")} & {len(x.as_py()) for x in right.column("vector")})
    parts = []
    for n in dims:
        same = lambda t: t.filter(pc.equal(pc.binary_length(t.column("vector")), n))  # noqa: E731,B023
        a, b = same(left), same(right)
        x, y = a.column("rep").to_numpy(), b.column("rep").to_numpy()
        near = vectors(a.column("vector")) @ vectors(b.column("vector")).T >= threshold
        near &= x[:, None] != y[None, :]
        links = near @ b.column("weight").to_numpy()
        root, top = x.copy(), np.iinfo(np.int64).max
        other = y.copy()
        while True:  # labels sink to the least id of each group in this block
            up = np.minimum(other, np.where(near, root[:, None], top).min(0))
            down = np.minimum(root, np.where(near, up[None, :], top).min(1))
            if (up == other).all() and (down == root).all():
                break
            other, root = up, down
        hung = (near.any(0)) & (other != y)
        parts.append((np.r_[x, y[hung]], np.r_[links, np.zeros(hung.sum(), np.int64)], np.r_[root, other[hung]]))
    if not parts:
        return empty
    rep, links, root = (np.concatenate(c) for c in zip(*parts))
    keep = (links > 0) | (rep != root)
    return pa.table({"rep": rep[keep], "links": links[keep], "root": root[keep]})


def cosine_links(table: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, n_links, component`` of every row: partners with a cosine of at least ``threshold`` and the least id reachable.

    Only rows with equal labels are compared. Rows whose label, key or vector is null, or whose vector is
    all zero or holds a null or a non-finite component, link with nothing; so do vectors of different
    lengths. Equal vectors link with each other. Rows that repeat a key are vectors of their own: each has its links and
    its component. An empty table gives no rows; other columns are not read.
    """
    radius = float(np.sqrt(2 - 2 * threshold))
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    good = usable("id", "v", "label")
    units = written(unit_rows(rows.where(good)), "units")
    everywhere = written(placed(units.drop("v"), chosen_pivots(units), radius), "cells")
    sizes = everywhere.groupBy("label", "cell").agg(
        F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("rights")
    )
    sized = everywhere.join(sizes.where("lefts > 0"), ["label", "cell"])
    block = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.greatest(F.col(n), F.lit(1))).cast("int")
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = sized.where("own").withColumn("i", block("lefts", 1)).select("*", F.explode(count("rights")).alias("j"), F.lit(0).alias("side"))
    right = sized.withColumn("j", block("rights", 2)).select("*", F.explode(count("lefts")).alias("i"), F.lit(1).alias("side"))
    columns = ["label", "cell", "i", "j", "side", "rep", "weight", "vector"]
    tasks = left.select(*columns).unionByName(right.select(*columns))
    found = tasks.groupBy("label", "cell", "i", "j").applyInArrow(lambda rows: compared(rows, threshold), "rep long, links long, root long")
    found = written(found, "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = units.select("label", "v", "rep", "least", "weight").join(links, "rep", "left").join(joined, "rep", "left")
    known = written(known.withColumn("component", F.coalesce("component", "rep")), "known")
    first = known.groupBy("component").agg(F.min("least").alias("first"))
    known = known.join(first, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first")
    linked = rows.where(good).join(known, ["label", "v"]).select("id", F.col("n_links").cast("long"), F.col("first").alias("component"))
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)
