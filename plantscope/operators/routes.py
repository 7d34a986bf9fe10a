"""Process-route tables: edges, dangling and disconnected nodes, repeated types, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.operators.stats import attach_stats
from plantscope.session import ensure_checkpoint_dir


def edge_list(nodes: DataFrame, node_id: str = "node_id", edges: str = "edges") -> DataFrame:
    """(from_id, to_id) from nodes with an array of outgoing targets; dangling targets drop out."""
    e = nodes.select(F.col(node_id).alias("from_id"), F.explode(edges).alias("to_id"))
    return e.join(nodes.select(F.col(node_id).alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")


def disconnected_nodes(nodes: DataFrame, edges: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Nodes that no edge touches. Edge ends fold to distinct ids before the join."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias(node_id)).distinct()
    return nodes.join(ends, node_id, "left_anti")


def repeated_types(nodes: DataFrame, node_type: str = "node_type") -> DataFrame:
    return nodes.groupBy(node_type).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def cyclic_edges(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Edges that stay when edges from nodes without an incoming edge, and edges into nodes without
    an outgoing one, are peeled off until nothing changes; empty exactly when the route has no cycle.

    Peeling works on distinct edges. Every round is cut off with a reliable checkpoint, and peels
    both ends, so a chain of length n needs about n / 2 rounds.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    left = edges.select("from_id", "to_id").distinct().checkpoint()
    count, rounds = left.count(), 0
    while count:
        with_source = left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi")
        kept = with_source.join(left.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi").select("from_id", "to_id").checkpoint()
        remaining = kept.count()
        rounds += 1
        if remaining == count:
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"route still shrinking after {max_rounds} rounds")
        left, count = kept, remaining
    return left


def route_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts, disconnected nodes, repeated types and whether there is a cycle."""
    parts = [
        nodes.agg(F.count(F.lit(1)).alias("n_nodes")),
        edges.agg(F.count(F.lit(1)).alias("n_edges")),
        disconnected_nodes(nodes, edges).agg(F.count(F.lit(1)).alias("n_disconnected")),
        repeated_types(nodes).agg(F.count(F.lit(1)).alias("n_repeated_types")),
        cyclic_edges(edges).agg((F.count(F.lit(1)) > 0).alias("has_cycle")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = attach_stats(out, p, [])
    return out
