"""Connected components of links that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach. links: (a, b), whole numbers, not null.

    Large-star and small-star steps: every node hands its larger (then its smaller) neighbours to the smallest one it
    knows. Each step is a grouped minimum and a join, so no node's links meet in one task, and each round's links are
    written to the shared folder. An empty table gives no row. Rounds grow with the logarithm of the largest component,
    and go on until nothing changes.
    """
    links = materialise(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct(), "links")
    seen = None
    while True:
        both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).union(links.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low < high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high")
        fresh = materialise(small.select(F.col("m").alias("low"), F.col("low").alias("high")).union(least.select(F.col("m").alias("low"), "high")).filter("low < high").distinct(), "links")
        state = tuple(fresh.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        forget(links)
        links = fresh
        if state == seen:
            break
        seen = state
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).union(links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
