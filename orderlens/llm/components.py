"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import drop_stored, store


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the greater ones; small: the lesser ones and itself) to its smallest neighbour."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    linked = pairs.join(low, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that ``edges`` (u, v; longs) holds.

    A step is an aggregate and a join on the node, both of which Spark can split for a hub;
    nothing is gathered per node and only one boolean a step reaches the driver. The steps end
    when every node has one link and no node with a link is linked to: edges that are in this
    form from the start take no step.
    """
    now = store(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    turn = 0
    while not _ended(now):
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = store(_stars(both, True).where("u != v").distinct(), f"cc{turn}l")
        small = store(_stars(large, False).where("u != v").distinct(), f"cc{turn}s")
        drop_stored(edges.sparkSession, large)
        drop_stored(edges.sparkSession, now)
        now = small
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _ended(links: DataFrame) -> bool:
    """Whether links from greater to lesser nodes all lead to the smallest node of their component at once."""
    ends = (links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("up"), F.lit(0).alias("down"))
            .unionByName(links.groupBy(F.col("v").alias("node")).agg(F.lit(0).alias("up"), F.lit(1).alias("down"))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()
