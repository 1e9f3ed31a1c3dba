"""Connected components of a link table, by alternating hops to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) for every node of ``links`` (``a``, ``b``).

    Each round joins a node's greater neighbours to its least one (large star), then its
    lesser neighbours (small star), until the links are stars. Rounds grow with the
    logarithm of the longest path; every round is written to the shared folder. A node's
    neighbours are never gathered: only their minimum, map-side combined, is joined back.
    Self links are allowed and null ends are ignored; no links give no rows.
    """
    edges = checkpointed(
        links.where("a is not null and b is not null")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("b").alias("node")).union(edges.select("a")).distinct()
    edges = edges.where("a < b")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = checkpointed(large)
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        edges = checkpointed(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        # A sum over the links, in one row; it stands still once every node hangs on its least node.
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return nodes.join(edges.select(F.col("b").alias("node"), F.col("a").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
