"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and the smallest node of its component (``root``), for all nodes on ``links`` (``u``, ``v``).

    Large-star and small-star steps in turn: every node is linked to the smallest node it knows, until
    nothing changes.  The steps only join and aggregate on nodes; each result is written and read again,
    so the lineage stays short, and both sides of a join are dealt out anew: adaptive execution can split a
    hub with many links.  Links of a node with itself make it a component of its own.
    """
    state, edges = None, stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                               .distinct(), "links")
    while True:
        both = edges.union(edges.select("v", "u")).distinct()
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least-neighbours")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u > v").distinct(), "large-star")
        lowest = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least-parents")
        small = (large.join(lowest, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*"))
        edges = stage(small.where("u > v").distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = members.select(F.col("root").alias("node"), "root")
    alone = links.where("u = v").select(F.col("u").alias("node"))
    found = members.union(roots).distinct()
    return found.union(alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
