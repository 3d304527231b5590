"""Graphs in node and edge form for drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours by type, and of communities by number (fixed values of our palette).
TYPE_COLOURS = {"PERSON": "#4E79A7", "ORGANIZATION": "#F28E2B", "LOCATION": "#59A14F", "EVENT": "#E15759", "SUPPLIER": "#F28E2B"}
OTHER_COLOUR = "#9C9C9C"
COMMUNITY_COLOURS = ["#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC"]


def type_colour(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TYPE_COLOURS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(kind)), F.lit(OTHER_COLOUR))


def community_colour(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMMUNITY_COLOURS)), (F.pmod(number, F.lit(10)) + 1).cast("int"))


def node_size(n: Column) -> Column:
    return F.least(F.lit(100), 50 + 5 * n)


def edge_style(label: Column, confidence: Column) -> tuple[Column, Column]:
    """Width by confidence (3 above 0.8, 2 above 0.6, else 1), dashed for similar and related labels."""
    c = F.coalesce(confidence, F.lit(0.5))
    return F.when(c > 0.8, 3).when(c > 0.6, 2).otherwise(1), F.lower(label).contains("similar") | F.lower(label).contains("related")


def entity_graph(entities: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` most mentioned entities and the edges among them."""
    from . import graph

    nodes = entities.orderBy(F.desc("mention_count"), "id").limit(n)
    return nodes.select("id", "name", "type", type_colour(F.col("type")).alias("colour"), node_size(F.col("mention_count")).alias("size")), graph.induced(edges, nodes)


def reasoning_graph(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of triplets ``(subject, relation, object, confidence, step)``: one node an entity, edges by their ends."""
    nodes = triplets.select(F.col("subject").alias("id"), "step").union(triplets.select("object", "step")).groupBy("id").agg(F.min("step").alias("first_step"))
    width, dashed = edge_style(F.col("relation"), F.col("confidence"))
    edges = triplets.groupBy("subject", "relation", "object").agg(F.max("confidence").alias("confidence"), F.min("step").alias("first_step"))
    return nodes, edges.select("subject", "relation", "object", "first_step", width.alias("width"), dashed.alias("dashed"))


def frames(items: DataFrame, id_col: str, step_col: str) -> DataFrame:
    """``step, ids``: what is first seen at each step."""
    first = items.groupBy(id_col).agg(F.min(step_col).alias("step"))
    return first.groupBy("step").agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
