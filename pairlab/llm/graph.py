"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: root is the smallest node reachable.

    Large-star and small-star steps in turn: every node hangs its larger
    neighbours, then its smaller ones, on the smallest node it sees, until the
    edges are stars.  A step is a grouped minimum (combined before the shuffle)
    and a join; nothing gathers a node's neighbours in one place.  The number of
    rounds grows with the logarithm of the largest component.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        edges = saved(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .distinct())
        # small star: smaller neighbours, and the node itself, go to the smallest one
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        down = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if (now := _state(edges)) == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
