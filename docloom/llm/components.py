"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def large_star(edges: DataFrame) -> DataFrame:
    """Hang the greater neighbours of each node on the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its lesser neighbours on the least of them. Edges run from greater to lesser."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (least id reachable) of every node of ``edges(a, b)``; loops and repeated edges are fine.

    Rounds grow with the logarithm of the component sizes; each is written to the shared folder. A
    node with very many neighbours is reduced before the shuffle, and its join can be split.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        edges = written(small_star(large_star(edges)), "edges")
        # a fixed point has only stars, whose number of edges and sum of centres stay the same
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
