"""Connected components of a links table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; nodes without links are absent.

    Every step hangs each node's greater neighbours on its smallest one (large star), then its
    smaller neighbours and itself (small star), until all edges point to roots.  The number of
    steps grows with the logarithm of a component's size; each writes its edges to the shared folder.
    """
    edges = stash(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(
            F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2_000_000_011)))
        ).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
