"""Connected components by alternating large and small stars, with every round cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that a link names; component is the smallest node reachable.

    Links have no direction; repeated links, loops and nulls do no harm (a loop alone gives no row). Each round sends
    every node's larger neighbours, then its smaller ones, to the smallest, so rounds grow with the logarithm of the
    longest path and a hub costs its links once.
    """
    pair = [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    edges = cut(links.where(F.col(a) != F.col(b)).select(*pair).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
