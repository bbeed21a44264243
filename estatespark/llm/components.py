"""Connected components of a graph given by its links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # Each neighbour goes to the least one, and so does the node itself.
    ends = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
    moved = down.join(least, "u").select(F.inline(ends).alias("u", "v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): every node of a link but the smallest of its component, and that smallest node.

    `links` is (u, v) of longs. Each step is an aggregation that combines before its shuffle and a join; the number of
    steps grows with the logarithm of the number of links. Every step is written, so no lineage builds up.
    """
    current = scratch.write(_small_star(links), "stars")
    seen = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            return current
        seen = mark
        following = scratch.write(_small_star(_large_star(current)), "stars")
        scratch.drop(current)
        current = following
