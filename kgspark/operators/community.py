"""Communities: Leiden by rounds of joins, delta screening, hierarchy rows, contexts and summaries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.runtime import discard, materialize

from . import graph
from .clients import first_sentence
from .numbering import numbered


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Newman modularity of ``membership (id, community)`` on distinct undirected pairs."""
    pairs = graph.projection(edges)
    m = pairs.count()
    if not m:
        return 0.0
    side = lambda end: membership.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
    inside = pairs.join(side("a"), "a").join(side("b"), "b").where("ca = cb").count() / m
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).join(membership, "id").groupBy("community").agg(F.count(F.lit(1)).alias("d"))
    return inside - (degree.agg(F.sum(F.pow(F.col("d") / (2 * m), F.lit(2)))).first()[0] or 0.0)


def _node_table(edges: DataFrame) -> DataFrame:
    """``a, c, k``: every node alone, with its weighted degree. ``edges`` has both directions (``a, b, w``)."""
    return edges.groupBy("a").agg(F.sum("w").alias("k")).select("a", F.col("a").alias("c"), "k")


def _chosen(links: DataFrame, nodes: DataFrame, m2: float) -> DataFrame:
    """``a, to``: for each node the community of the largest modularity gain, where that beats its own.

    ``links``: ``a, own, k, c, w``, the weight from node ``a`` to community
    ``c``; a row for its own community is there even without weight. Ties go to
    the least name.
    """
    totals = nodes.groupBy("c").agg(F.sum("k").alias("total"))
    seen = links.groupBy("a", "own", "k", "c").agg(F.sum("w").alias("w")).join(totals, "c", "left")
    rest = F.coalesce("total", F.lit(0.0)) - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
    gains = seen.withColumn("gain", F.col("w") - rest * F.col("k") / m2)
    best = gains.groupBy("a").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.min(F.when(F.col("c") != F.col("own"), F.struct((-F.col("gain")).alias("less"), "c"))).alias("best"))
    return best.where(-F.col("best.less") > F.col("stay") + 1e-12).select("a", F.col("best.c").alias("to"))


def _links(edges: DataFrame, movers: DataFrame, targets: DataFrame) -> DataFrame:
    """Weights from movers (``a, own, k``) to the communities of their neighbours among ``targets`` (``b, c``), and a row for their own."""
    return edges.join(movers, "a").join(targets, "b").select("a", "own", "k", "c", "w").unionByName(movers.select("a", "own", "k", F.col("own").alias("c"), F.lit(0.0).alias("w")))


def _turn(nodes: DataFrame, seed: int, turn: int, parts: int = 2) -> DataFrame:
    """The nodes whose turn it is, one in ``parts``, or the edges from them; every turn draws anew, so no two neighbours keep swapping."""
    return nodes.where(F.pmod(F.xxhash64("a", F.lit(seed), F.lit(turn)), F.lit(parts)) == 0)


def _with_moves(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    return nodes.join(moves, "a", "left").select("a", F.coalesce("to", "c").alias("c"), "k", F.col("to").isNotNull().alias("moved"))


def _quality(edges: DataFrame, nodes: DataFrame, m2: float) -> float:
    """Modularity of ``nodes``, but for the weight inside nodes of ``edges``, which no move changes."""
    own = nodes.select("a", "c")
    inside = edges.join(own, "a").join(own.select(F.col("a").alias("b"), F.col("c").alias("other")), "b").where("c = other").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    spread = nodes.groupBy("c").agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum(F.pow(F.col("k") / m2, 2.0)), F.lit(0.0)).alias("spread"))
    row = inside.join(spread).first()
    return row["inside"] / m2 - row["spread"]


def _turns(edges: DataFrame, nodes: DataFrame, m2: float, seed: int, most_turns: int, parts: int) -> DataFrame:
    """Turns of local moving, of ever fewer nodes at once, until two on end would move at most one node in 100."""
    n, quiet, now = nodes.count(), 0, nodes
    for turn in range(most_turns):
        share = parts * 2 ** (turn // 3)
        movers = _turn(now, seed, turn, share).select("a", F.col("c").alias("own"), "k")
        # edges of nodes that keep still are left out where they are read, not by a join that moves them all
        moves = _chosen(_links(_turn(edges, seed, turn, share), movers, now.select(F.col("a").alias("b"), "c")), now, m2)
        after = materialize(_with_moves(now.select("a", "c", "k"), moves), "leiden-nodes")
        if now is not nodes:
            discard(now)
        now, moved = after, after.where("moved").count()
        quiet = quiet + 1 if moved * share <= n // 100 else 0
        if quiet == 2:
            break
    return now


def _move(edges: DataFrame, nodes: DataFrame, m2: float, seed: int, most_turns: int) -> tuple[DataFrame, float]:
    """Local moving: the nodes after it, and the modularity gained.

    Nodes that move at once do not see each other's moves, so on dense graphs
    the modularity may fall. Then the turns are taken back and repeated with
    fewer nodes at once; if that fails too, the nodes stay as they were.
    """
    before = _quality(edges, nodes, m2)
    for parts in (2, 16):
        after = _turns(edges, nodes, m2, seed, most_turns, parts)
        gained = _quality(edges, after, m2) - before
        if gained >= 0:
            discard(nodes)
            return after, gained
        discard(after)
    return nodes, 0.0


def _refine(edges: DataFrame, nodes: DataFrame, m2: float, seed: int, turns: int) -> DataFrame:
    """``a, c, k, sub``: inside each community, nodes that are alone join a neighbour's part if that gains.

    Only nodes alone move, to parts of nodes that keep still in that turn, so
    every part is connected.
    """
    placed = nodes.select("a", F.col("c").alias("home"), "k", F.col("a").alias("c"))
    inner = edges.join(nodes.select("a", F.col("c").alias("ca")), "a").join(nodes.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", "w")
    inner = materialize(inner, "leiden-inner")
    for turn in range(turns):
        alone = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("c")
        movers = materialize(_turn(placed.join(alone, "c", "left_semi"), seed + 1, turn).select("a", F.col("c").alias("own"), "k"), "leiden-movers")
        still = placed.join(movers.select("a"), "a", "left_anti").select(F.col("a").alias("b"), "c")
        moves = _chosen(_links(_turn(inner, seed + 1, turn), movers, still), placed, m2)
        after = materialize(placed.join(moves, "a", "left").select("a", "home", "k", F.coalesce("to", "c").alias("c")), "leiden-parts")
        discard(placed, movers)
        placed = after
    discard(inner)
    return placed.select("a", F.col("home").alias("c"), "k", F.col("c").alias("sub"))


def detect_communities(edges: DataFrame, seed: int = 42, most_levels: int = 10, most_turns: int = 9, refine_turns: int = 3, least_gain: float = 0.001) -> DataFrame:
    """``id, level, community``: levels of the Leiden procedure, 0 the coarsest; communities are named by their least member.

    Local moving, refinement and aggregation are joins and aggregations at every
    size: no step gathers a community or a component in one task. A part of the
    nodes, drawn anew and smaller from turn to turn, moves at once to the
    neighbouring communities of the largest modularity gain. Refinement splits
    communities into connected parts, which are the nodes of the next round. It
    ends when communities are single nodes and moving gains less than
    ``least_gain``; only rounds that gain are levels. At the end single nodes move
    once more between the coarsest communities. Loops and repeated edges do
    not count; an empty table gives no rows.
    """
    named = edges.where("src <> dst").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    names = materialize(numbered(named.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), ["id"], "n"), "leiden-names")
    # numbers in the order of the names, so that ties and least members are the same and rows are short
    at = lambda end: names.select(F.col("id").alias(end), F.col("n").cast("long").alias(f"{end}_n"))
    pairs = graph.projection(named.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")))
    pairs = materialize(pairs, "leiden-pairs")
    both = materialize(pairs.select("a", "b", F.lit(1.0).alias("w")).union(pairs.select("b", "a", F.lit(1.0))), "leiden-edges")
    discard(pairs)
    m2 = float(both.count()) or 1.0
    nodes = materialize(_node_table(both), "leiden-nodes")
    members = materialize(nodes.select(F.col("a").alias("id"), "a"), "leiden-members")
    base, degrees = both, materialize(nodes.select("a", "k"), "leiden-degrees")
    found = []
    for level in range(most_levels):
        nodes, gained = _move(both, nodes, m2, seed + 1000 * level, most_turns)
        if gained >= least_gain or not found:
            found.append(materialize(members.join(nodes.select("a", "c"), "a").select("id", F.col("c").alias("group")), "leiden-level"))
        # parts of one community may still have to become one node before communities can join
        if gained < least_gain and nodes.count() == nodes.select("c").distinct().count():
            break
        parts = _refine(both, nodes, m2, seed + 1000 * level, refine_turns)
        parts = materialize(parts, "leiden-parts")
        of = parts.select("a", "sub")
        fewer = both.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("sub").alias("other")), "b").where("sub <> other").groupBy(F.col("sub").alias("a"), F.col("other").alias("b")).agg(F.sum("w").alias("w"))
        fewer = materialize(fewer, "leiden-edges")
        # a part starts in the community that it was split from
        grown = parts.groupBy(F.col("sub").alias("a"), "c").agg(F.sum("k").alias("k"))
        grown = materialize(grown, "leiden-nodes")
        members = materialize(members.join(of, "a").select("id", F.col("sub").alias("a")), "leiden-members")
        small = grown.count() == nodes.count()
        discard(both if both is not base else None, nodes, parts)
        both, nodes = fewer, grown
        if small:
            break
    # single nodes may still gain by leaving what their part was moved to
    coarse = materialize(found.pop().select(F.col("id").alias("a"), F.col("group").alias("c")).join(degrees, "a"), "leiden-nodes")
    nodes, _ = _move(base, coarse, m2, seed - 1, most_turns)
    found.append(nodes.select(F.col("a").alias("id"), F.col("c").alias("group")))
    discard(base, degrees)
    last = len(found) - 1
    levels = None
    for i, part in enumerate(found):
        least = part.groupBy("group").agg(F.min("id").alias("n")).join(names, "n").select("group", F.col("id").alias("community"))
        rows = part.select(F.col("id").alias("n"), "group").join(least, "group").join(names, "n").select("id", F.lit(last - i).cast("int").alias("level"), "community")
        levels = rows if levels is None else levels.unionByName(rows)
    return levels


def detect_incrementally(edges: DataFrame, old: DataFrame, changed: DataFrame, seed: int = 42, most_cycles: int = 8) -> DataFrame:
    """``id, community`` after a change, by delta screening.

    ``edges`` is the graph as it is now, ``old`` (``id, community``) the stored
    communities, ``changed`` the nodes whose edges came, went or are new. Only
    nodes whose gain can have changed are looked at: the changed ones, their
    neighbours, then the neighbours of whatever moved. A node may also leave
    for a community of its own. Nodes without a stored community start alone;
    nodes that have no edge any more keep theirs; communities that no move
    touches keep their names.
    """
    pairs = graph.projection(edges).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    both = materialize(pairs.select("a", "b", F.lit(1.0).alias("w")).union(pairs.select("b", "a", F.lit(1.0))), "delta-edges")
    m2 = float(both.count()) or 1.0
    stored = old.select(F.col("id").cast("string").alias("a"), F.col("community").cast("string").alias("community")).dropDuplicates(["a"])
    degrees = both.groupBy("a").agg(F.sum("w").alias("k"))
    nodes = materialize(degrees.join(stored, "a", "full").select("a", F.coalesce("community", F.concat(F.lit("new:"), "a")).alias("c"), F.coalesce("k", F.lit(0.0)).alias("k")), "delta-nodes")
    touched = changed.select(F.col(changed.columns[0]).cast("string").alias("a")).distinct()
    looked = materialize(_around(touched, both), "delta-looked")
    for cycle in range(most_cycles):
        moved = []
        for half in (0, 1):
            turn = F.pmod(F.xxhash64("a", F.lit(seed), F.lit(cycle)), F.lit(2)) == half
            movers = nodes.join(looked, "a", "left_semi").where(turn).select("a", F.col("c").alias("own"), "k")
            links = _links(both, movers, nodes.select(F.col("a").alias("b"), "c"))
            alone = movers.select("a", "own", "k", F.concat(F.lit("new:"), "a").alias("c"), F.lit(0.0).alias("w"))
            after = materialize(_with_moves(nodes.select("a", "c", "k"), _chosen(links.unionByName(alone), nodes, m2)), "delta-nodes")
            discard(nodes)
            nodes = after
            moved.append(materialize(nodes.where("moved").select("a"), "delta-moved"))
        further = materialize(_around(moved[0].union(moved[1]).distinct(), both), "delta-looked")
        discard(looked, *moved)
        looked = further
        if looked.isEmpty():
            break
    return nodes.select(F.col("a").alias("id"), F.col("c").alias("community"))


def _around(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """The nodes (``a``) and their neighbours."""
    return nodes.union(both.join(nodes, "a", "left_semi").select(F.col("b").alias("a"))).distinct()


def assignments(levels: DataFrame) -> DataFrame:
    """Membership rows: confidence 0.95 at the base level, 0.85 at the others; key (level, community)."""
    return levels.select(F.col("id").alias("entity_id"), F.col("community").alias("community_id"), F.col("level").alias("community_level"), F.when(F.col("level") == 0, 0.95).otherwise(0.85).alias("confidence"))


def statistics(membership: DataFrame) -> DataFrame:
    """One row: communities, members, mean, least and largest size; zeros for an empty table."""
    sizes = membership.groupBy("community").agg(F.count_distinct("id").alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_communities"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_members"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_size"),
        F.coalesce(F.min("size"), F.lit(0)).alias("min_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
    )


def members(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """``community, n_members, n_edges``: members and edges inside."""
    m = membership.select("id", "community")
    inside = edges.join(m.withColumnsRenamed({"id": "src"}), "src").join(m.withColumnsRenamed({"id": "dst", "community": "other"}), "dst").where("community = other").groupBy("community").agg(F.count(F.lit(1)).alias("n_edges"))
    return m.groupBy("community").agg(F.count_distinct("id").alias("n_members")).join(inside, "community", "left").select("community", "n_members", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def contexts(membership: DataFrame, entities: DataFrame, edges: DataFrame, n_members: int = 20, n_edges: int = 30) -> DataFrame:
    """``community, members, relations``: the most mentioned members and strongest inner edges, as text arrays."""
    named = membership.join(entities.select("id", "name", "mention_count"), "id")
    first = graph.top_per_group(named, ["community"], [F.desc("mention_count"), F.col("id")], n_members)
    people = first.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("members"))
    m = membership.select("id", "community")
    inside = edges.join(m.withColumnsRenamed({"id": "src"}), "src").join(m.withColumnsRenamed({"id": "dst", "community": "other"}), "dst").where("community = other")
    best = graph.top_per_group(inside, ["community"], [F.desc("confidence"), F.col("src"), F.col("dst"), F.col("rel_key")], n_edges)
    rels = best.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "src", "rel_key", "dst").alias("t")))), lambda x: x["t"]).alias("relations"))
    return people.join(rels, "community", "left").select("community", "members", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"))


def context_text(context: DataFrame, n_members: int = 20, n_relations: int = 15) -> DataFrame:
    """``community, text`` with "and k more" where lists are cut."""

    def part(title: str, column: str, n: int):  # noqa: ANN202
        more = F.size(column) - n
        return F.concat(F.lit(title), F.concat_ws("; ", F.slice(column, 1, n)), F.when(more > 0, F.concat(F.lit("; and "), more.cast("string"), F.lit(" more"))).otherwise(""))

    return context.select("community", F.concat_ws("\n", part("Members: ", "members", n_members), part("Relations: ", "relations", n_relations)).alias("text"))


def summarize(texts: DataFrame, make: Callable[[], Callable[[str], str]] = lambda: first_sentence) -> DataFrame:
    """``community, summary`` from ``community, text`` by a generator made once a partition."""

    def run(batches):  # noqa: ANN001, ANN202
        generate = make()
        for pdf in batches:
            yield pd.DataFrame({"community": pdf["community"].astype(str), "summary": [generate(t) for t in pdf["text"]]})

    return texts.select("community", "text").mapInPandas(run, "community string, summary string")
