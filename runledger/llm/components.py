"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node it reaches.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the least of them; edges end as one star for each component, after a number
    of rounds that grows with the logarithm of the longest path. A node with
    very many neighbours is a minimum that combines before the shuffle and a
    join whose skewed side is split. Nothing is held by the driver.

    Args:
        edges: Two columns of one orderable type; loops and repeats are fine.
    """
    a, b = edges.columns
    stars = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        state = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
