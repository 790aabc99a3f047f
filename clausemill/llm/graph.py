"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """node, component of every node in links(a, b): component is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): each node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones, until nothing changes; the number of rounds grows with the logarithm of the
    longest path. Every round is grouped and joined by node and written to the shared folder; only the count of links
    and a sum of hashes come to the driver. Self-links and repeats are harmless; no links give no rows.
    """
    pairs = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, pairs = pairs, materialise(small)
        release(before)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
