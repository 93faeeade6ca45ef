"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the smallest node of its component.

    Each round hangs every larger neighbour of a node, then every smaller one, on the smallest; a component of any
    shape becomes a star in a number of rounds that grows with the logarithm of its diameter. Links are a table in
    the shared folder after each round, minima are aggregated before the shuffle, and a hub's links are joined to
    one row, which skew handling can split.
    """
    star = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = scratch.save(star, f"{name}0")
    turn = 0
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        turn += 1
        large = scratch.save(large, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        turn += 1
        star = scratch.save(small, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        n, different = star.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        if n == different and star.select(F.col("b").alias("a")).join(star.select("a"), "a", "left_semi").isEmpty():
            break  # every node hangs on one that hangs on none
    nodes = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
