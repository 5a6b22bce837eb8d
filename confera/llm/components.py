"""Connected components of a graph of links, by alternating large-star and small-star steps.

Defined results: a link of a node to itself says nothing, and repeated links count once, in either direction. Nodes are
whole numbers and never null. No links give an empty result. Only the two columns named are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confera.llm.common import checkpointed


def _star(links: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself, over links in both directions."""
    return links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: (a, b). node, root (the least node of its component) of every node that has a link.

    Nodes are whole numbers. A step replaces the links of a node by links to its least neighbour; only minima are kept per node, so a hub's links are
    combined before they are shuffled. Written anew each round; an unfinished graph after `rounds` rounds is an error.
    """
    down = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    # A round never has more links than twice those of the one before it, and mostly fewer.
    size = 2 * down.count()
    for _ in range(rounds):
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _star(both).select(F.col("a").bitwiseXOR(F.lit(0)).alias("a"), "m")
        # Large star: every larger neighbour moves to the node's least.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = checkpointed(large, size)
        # Small star: every smaller neighbour, and the node, move to the least of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least.select(F.col("a").bitwiseXOR(F.lit(0)).alias("a"), "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        new = checkpointed(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), size)
        # Done when no node is above one link and at the top of another.
        if new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and new.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        down = new
    raise RuntimeError(f"components are unfinished after {rounds} rounds")
