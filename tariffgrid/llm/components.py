"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffgrid.llm.common import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge; comp is the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step hangs
    a node's neighbours on the least of them, so that hubs only ever send one row for
    each neighbour, and every component ends as a star about its least node. The
    edges stay distributed; the driver sees one flag a round.
    """
    now = durable(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    seen = _sum(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select("v", "m")
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.col("least").alias("v")).unionByName(low.select(F.col("v").alias("u"), F.col("least").alias("v")))
        after = durable(small.where("u <> v").distinct())
        if (sum_ := _sum(after)) == seen:
            break
        now, seen = after, sum_
    stars = after.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


def _sum(edges: DataFrame) -> tuple:
    """Count and combined hash of distinct edges: the same for the same set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
