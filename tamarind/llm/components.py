"""Connected components of a link table by alternating large-star and small-star rounds.

Each round joins edges with the least neighbour of a node, which is aggregated
before the shuffle; no node's neighbours are ever gathered.  Rounds are written
to the shared folder, so a lost executor costs one round.  They end, or never
begin, once the edges are stars around the least nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two edges down, and none that has one is the end of another: then each ``v`` is its component's least."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where(F.col("down") + F.col("up") > 1).agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); the component is its least node."""
    known = shared.settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(known):
        # large star: neighbours above a node move to its least neighbour
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = shared.settle(moved, "edges")
        shared.discard(known)
        known = new
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
