"""Neighbourhoods, paths, subgraphs and counts over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.runtime import materialize


def undirected(edges: DataFrame, *keep: str) -> DataFrame:
    """Every edge from both ends: ``src, dst`` and the kept columns."""
    return edges.select("src", "dst", *keep).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keep))


def projection(edges: DataFrame) -> DataFrame:
    """Distinct undirected pairs, smaller id first, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def induced(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with both ends among ``nodes``."""
    n = nodes.select(F.col(id_col).alias("n_"))
    return edges.join(n, F.col("src") == F.col("n_"), "left_semi").join(n, F.col("dst") == F.col("n_"), "left_semi")


def context(edges: DataFrame, centre: DataFrame, hops: int = 2) -> DataFrame:
    """``id, distance, rel_key`` of nodes up to ``hops`` away from the one-column table ``centre``.

    A node reached at several distances has a row for each, and two hops may
    lead back to the centre.
    """
    both = undirected(edges, "rel_key")
    front = centre.select(F.col(centre.columns[0]).alias("id"))
    out = None
    for d in range(1, hops + 1):
        step = front.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(d).alias("distance"), "rel_key").distinct()
        out = step if out is None else out.unionAll(step)
        front = step.select("id").distinct()
    return out


def ego(edges: DataFrame, centre: DataFrame, hops: int = 2) -> DataFrame:
    """``id, distance``: least number of edges from the centre, itself at 0."""
    both = undirected(edges).distinct()
    seen = centre.select(F.col(centre.columns[0]).alias("id"), F.lit(0).alias("distance"))
    front = seen
    for d in range(1, hops + 1):
        step = front.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        seen, front = seen.unionByName(step), step
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 3) -> DataFrame:
    """One shortest undirected path (``hops, path``) of at most ``most`` edges, the least by node names; no row without one.

    Frontiers keep one least path a node, so the table never exceeds the nodes reached.
    """
    both = undirected(edges).distinct()
    front = edges.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = front.select("id")
    for d in range(most + 1):
        hit = front.where(F.col("id") == goal)
        if d == most or not hit.isEmpty():
            return hit.select(F.lit(d).alias("hops"), "path")
        step = front.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id2"), F.array_append("path", F.col("dst")).alias("path")).withColumnRenamed("id2", "id")
        front = materialize(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "bfs")
        seen = seen.unionByName(front.select("id"))
    raise AssertionError


def path_between(edges: DataFrame, membership: DataFrame, start: str, goal: str, most: int = 3) -> DataFrame:
    """``kind, n_edges, hops, path``: members of one community (at any level) have the number of their direct edges, others a shortest path."""
    shared = membership.where(F.col("id") == start).select("community").join(membership.where(F.col("id") == goal).select("community"), "community", "left_semi")
    if shared.isEmpty():
        return shortest_path(edges, start, goal, most).select(F.lit("path").alias("kind"), F.lit(None).cast("long").alias("n_edges"), "hops", "path")
    direct = edges.where(((F.col("src") == start) & (F.col("dst") == goal)) | ((F.col("src") == goal) & (F.col("dst") == start)))
    return direct.agg(F.count(F.lit(1)).alias("n_edges")).select(F.lit("same_community").alias("kind"), "n_edges", F.lit(None).cast("int").alias("hops"), F.lit(None).cast("array<string>").alias("path"))


def context_texts(mentions: DataFrame, text_units: DataFrame, centre: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` text units that mention the entities of ``centre``: ``text_unit_id, start_char, text``."""
    own = mentions.join(F.broadcast(centre.select(F.col(centre.columns[0]).alias("entity_id"))), "entity_id", "left_semi").select("text_unit_id").distinct()
    return own.join(text_units.select(F.col("id").alias("text_unit_id"), "start_char", "text"), "text_unit_id").orderBy("start_char", "text_unit_id").limit(n)


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def boundary(edges: DataFrame, membership: DataFrame, a, b, examples: int = 10) -> DataFrame:  # noqa: ANN001
    """Two communities compared: members at the boundary, crossing edges, first examples."""
    left = membership.where(F.col("community") == a).select(F.col("id").alias("src"))
    right = membership.where(F.col("community") == b).select(F.col("id").alias("dst"))
    cross = undirected(edges).join(left, "src").join(right, "dst")
    counts = cross.agg(F.count_distinct("src").alias("n_left"), F.count_distinct("dst").alias("n_right"), F.count(F.lit(1)).alias("n_paths"))
    # a top-k before the list: the row never holds more than the examples
    first = cross.select(F.concat_ws("-", "src", "dst").alias("pair")).distinct().orderBy("pair").limit(examples)
    return counts.join(first.agg(F.array_sort(F.collect_list("pair")).alias("examples")))


def between_communities(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``c1, c2, n_edges`` for communities c1 < c2 with edges between their members."""
    m = membership.select("id", "community")
    joined = edges.join(m.withColumnsRenamed({"id": "src", "community": "x"}), "src").join(m.withColumnsRenamed({"id": "dst", "community": "y"}), "dst").where("x <> y")
    return joined.groupBy(F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2")).agg(F.count(F.lit(1)).alias("n_edges"))
