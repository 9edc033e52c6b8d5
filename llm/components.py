"""Connected components of a table of links, by alternating large and small stars.

A large star links every larger neighbour of a node to the node's smallest neighbour, a small
star the node and its smaller neighbours; both keep the components, and a few rounds leave
stars around the smallest node of each.  All steps are joins and aggregations with partial
sums; each round is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """links: columns a, b (long).  Returns node, root (the smallest node that it reaches) of all linked nodes."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        now = written(_star(_star(now, True), False), f"{name}-stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
