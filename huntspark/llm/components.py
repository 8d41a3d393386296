"""Connected components of a table of links, by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: neighbours are tied to the least of them instead of to each other.

    ``edges`` has ``u > v``. Large: of every node the greater neighbours go to
    its least neighbour. Small: the node and its lesser neighbours do. A large
    round makes one row of each edge at most, so only the small one that follows
    takes equal rows together.
    """
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = pairs.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.filter("u <> v")
    return out if large else out.dropDuplicates()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, least``: every linked node with the least node of its component.

    Each round is one aggregation and one join over the links, which become
    stars; the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").dropDuplicates())
    mark = None
    while True:
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    tails = edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
    return tails.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("least"))).groupBy("node").agg(F.min("least").alias("least"))
