"""Connected components of a table of links, by alternating large-star and small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` in either direction, repeats allowed, to (node, root): every node
    that has a link to another node, with the smallest node it reaches.

    Only minima are aggregated, so a hub's neighbours never meet in one task. They get its
    minimum by a join of two written tables, which AQE splits where a hub is hot. Each
    round's links go to the shared folder. The number of rounds grows with the logarithm of
    the longest chain. Nodes are of any type that Spark orders.
    """
    ends = F.array(F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edges = saved(links.where("a <> b").select(F.explode(ends).alias("e")).select("e.*").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        own = low.select("u", F.col("m").alias("v"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(own.unionByName(small).distinct(), "small-star")
        # three sums tell whether a round changed the set of links
        h = F.xxhash64("u", "v")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
