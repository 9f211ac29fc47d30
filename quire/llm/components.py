"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged


def settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: each u has one edge, and no v is a u."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(staged(edges.select(F.col("v").alias("root")).distinct(), "centres"), F.col("u") == F.col("root"), "left_semi").isEmpty()


def roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for each node of the links (u, v), root being the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest of its neighbourhood; the edges become stars in a number of
    rounds that grows with the logarithm of the longest path. What a round makes is written
    to the shared folder, so a lost executor costs no more than one step, and
    joins have a plain shuffle on either side: a star's centre is a hot key, which
    adaptive execution splits. Nodes without links and links of a node to itself
    have no row.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        if settled(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
