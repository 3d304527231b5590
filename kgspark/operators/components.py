"""Connected components of an edge table by contraction, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.runtime import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node with an edge to another; component = a node of it, the same for all.

    Each round maps every node to the least of itself and its neighbours and
    rewrites the edges over these images; loops go. At least every node next to
    a smaller one disappears, so few rounds are needed, and each works on a
    smaller graph. The component's name is its least node. Null ends are ignored.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    live = materialize(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    labels = nodes = nodes.withColumn("component", F.col("node"))  # read from the edges until the first round
    for _ in range(most_rounds):
        if live.isEmpty():
            discard(live if labels is not nodes else None)
            return labels
        # edges are ordered, so only the larger end has a smaller neighbour
        step = materialize(live.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")), "cc-step")
        named = labels.join(step, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
        named = materialize(named, "cc-labels")
        # a hub's many edges are one row before they meet again on the hub's key
        half = live.join(step.select(F.col("from").alias("b"), F.col("to").alias("b2")), "b").select("a", "b2").distinct()
        moved = half.join(step.select(F.col("from").alias("a"), F.col("to").alias("a2")), "a", "left")
        moved = moved.select(F.coalesce("a2", "a").alias("x"), F.col("b2").alias("y")).where("x <> y")
        rest = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        discard(live, step, labels)
        live, labels = rest, named
    raise RuntimeError("components did not settle")
