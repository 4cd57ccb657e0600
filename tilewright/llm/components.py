"""Connected components of a table of links by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) joined back to the links, so that a node with a third of all links
is only ever a large join key, which adaptive execution splits. The links are written to the shared folder after each round. Rounds end when the links are
stars: every node that has a smaller neighbour has one only, which has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    """Links of each node's larger neighbours to its least one; there may be repeats."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(links: DataFrame) -> DataFrame:
    """Links (to smaller nodes) of each node's smaller neighbours, and of the node, to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(own).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether links (to smaller nodes, without repeats) are stars."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link.

    links: integer columns a and b; nulls, loops and repeats count for nothing. Nodes without a link to another node don't appear. The rounds grow with the logarithm of the longest path, so
    sixty are far more than any table needs.
    """
    down = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(down.distinct(), "links")
    for _ in range(most_rounds):
        if _stars(now):
            node = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return node.union(node.select(F.col("component").alias("node"), "component")).distinct()
        new = written(_small_star(_large_star(now)), "links")
        discard(now)
        now = new
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
