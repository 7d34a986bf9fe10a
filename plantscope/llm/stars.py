"""Connected components by alternating large and small stars, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.llm.common import one_row, shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """The number of edges first, and what tells sets of edges apart."""
    mark = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(a % 1000003)").alias("s"))
    return tuple(one_row(edges.sparkSession, mark))


def connected(links: DataFrame) -> DataFrame:
    """(node, root: the smallest node reached) of every node of ``links(a, b)``.

    Nodes are integers; loops and repeated links do not matter. Each round is a table in the shared
    folder; rounds end when the set of edges stays the same, after O(log**2 n) of them, or
    one if the links are stars already. Hubs are keys of partial aggregates and of equality joins.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = shared_table(links.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "stars")
    now = _mark(edges)
    while True:
        before = now
        if before[0]:
            edges = shared_table(_small_star(_large_star(edges)), "stars")
            now = _mark(edges)
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
