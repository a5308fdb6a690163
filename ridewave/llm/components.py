"""Connected components of links, by alternating stars on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import written


def _stars(links: DataFrame) -> DataFrame:
    """One large and one small star step over links (a > b); every step keeps the components and pulls nodes to their least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        links.join(least, "a").where("b = m").select("a", "b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``links`` (a, b), in any number of rounds until nothing changes.

    No group is gathered: a node's least neighbour is an aggregate joined back, and Spark splits hot nodes in that join.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        now = written(_stars(now), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
