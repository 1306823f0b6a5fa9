"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long): the smallest node that it reaches.

    A round is two joins with per-node minima. Edges are pairs of numbers; those of a node with very many neighbours
    meet its minimum in one task, which adaptive execution splits once they are more than a partition should hold.
    Each round is written to the shared folder; rounds grow with the logarithm of the graph's size. Self-loops and
    null ends are ignored; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(pairs, "edges")
    mark = _mark(current)
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(root, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(root.select("a", "m")).distinct()
        current = stored(small, "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
