"""Communities by joins against plain Leiden, and delta screening against a full run."""

import inspect
import random

import plain_leiden
import pytest

from kgspark.operators import community
from kgspark.operators.components import connected_components


def planted(rng, n=120, groups=6, inside=0.35, outside=0.02):
    return [(f"v{i:03d}", f"v{j:03d}") for i in range(n) for j in range(i) if rng.random() < (inside if i % groups == j % groups else outside)]


@pytest.fixture(scope="module")
def graph(spark):
    rows = planted(random.Random(5))
    edges = spark.createDataFrame([*rows, rows[0], (rows[1][1], rows[1][0]), ("v001", "v001")], "src string, dst string").cache()
    found = community.detect_communities(edges).cache()
    return rows, edges, found


def test_modularity_is_that_of_plain_leiden(spark, graph):
    rows, edges, found = graph
    best = plain_leiden.leiden(rows)[-1]
    want = community.modularity(edges, spark.createDataFrame([(k, str(v)) for k, v in best.items()], "id string, community string"))
    assert community.modularity(edges, found.where("level = 0").select("id", "community")) >= 0.99 * want > 0.3


def test_every_level_covers_every_node_once(graph):
    rows, _, found = graph
    nodes = {x for e in rows for x in e}
    levels = {}
    for r in found.collect():
        levels.setdefault(r["level"], []).append((r["id"], r["community"]))
    assert set(levels) == set(range(len(levels)))
    for pairs in levels.values():
        assert len(pairs) == len(nodes) and {i for i, _ in pairs} == nodes
        members = {}
        for i, c in pairs:
            members.setdefault(c, []).append(i)
        assert all(c == min(v) for c, v in members.items())


def test_refined_parts_are_connected(spark, graph):
    _, edges, found = graph
    pairs = edges.where("src <> dst").selectExpr("src AS a", "dst AS b").distinct()
    both = pairs.selectExpr("a", "b", "1.0D AS w").union(pairs.selectExpr("b", "a", "1.0D"))
    degree = both.groupBy("a").sum("w").withColumnRenamed("sum(w)", "k")
    homes = found.where("level = 0").selectExpr("id AS a", "community AS c").join(degree, "a")
    parts = community._refine(both, homes, float(both.count()), 1, 4).cache()
    own = {r["a"]: r["sub"] for r in parts.collect()}
    inner = spark.createDataFrame([(r["a"], r["b"]) for r in pairs.collect() if own[r["a"]] == own[r["b"]]], "a string, b string")
    component = {r["node"]: r["component"] for r in connected_components(inner).collect()}
    sizes = {}
    for a, sub in own.items():
        sizes.setdefault(sub, set()).add(component.get(a, a))
    assert all(len(v) == 1 for v in sizes.values()) and len(sizes) < len(own)


def test_no_step_gathers_a_community():
    text = inspect.getsource(community)
    assert "applyInPandas" not in text and "most_edges" not in text


def test_delta_screening_is_as_good_as_a_full_run(spark, graph):
    rows, edges, found = graph
    old = found.where("level = 0").select("id", "community")
    rng = random.Random(6)
    where = {r["id"]: r["community"] for r in old.collect()}
    names = sorted(set(where.values()))
    moved = next(i for i in sorted(where) if where[i] == names[0] and i != names[0])
    goal = rng.sample([i for i in where if where[i] == names[1]], 10)
    now = [e for e in rows if moved not in e] + [(moved, g) for g in goal] + [("new1", "new2"), ("new2", "new3"), ("new1", "new3")]
    changed = spark.createDataFrame([(moved,), ("new1",), ("new2",), ("new3",), (None,)], "id string")
    fresh = spark.createDataFrame(now, "src string, dst string")
    got = {r["id"]: r["community"] for r in community.detect_incrementally(fresh, old, changed).collect()}
    assert got[moved] == names[1] and got["new1"] == got["new2"] == got["new3"] and got["new1"].startswith("new:")
    assert set(got) == set(where) | {"new1", "new2", "new3"}
    assert all(got[i] == where[i] for i in where if where[i] in names[2:])
    q = community.modularity(fresh, spark.createDataFrame(sorted(got.items()), "id string, community string"))
    full = plain_leiden.leiden(sorted(set(now)))[-1]
    assert q >= 0.99 * community.modularity(fresh, spark.createDataFrame([(k, str(v)) for k, v in full.items()], "id string, community string"))


def test_rounds_run_on_numbers_not_on_names(spark, monkeypatch):
    kinds, real = [], community._move
    monkeypatch.setattr(community, "_move", lambda edges, nodes, *a: (kinds.extend([*edges.dtypes, *nodes.dtypes]), real(edges, nodes, *a))[1])
    edges = spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "y")], "src string, dst string")
    found = community.detect_communities(edges, most_levels=1, most_turns=1, refine_turns=1)
    assert {(r["id"], r["community"]) for r in found.where("level = 0").collect()} in ({("x", "x"), ("y", "x")}, {("x", "x"), ("y", "y")})
    assert kinds and all(kind in ("bigint", "double", "boolean") for _, kind in kinds)


def test_a_turn_moves_only_the_edges_of_its_nodes(spark, monkeypatch):
    sizes, real = [], community._links
    monkeypatch.setattr(community, "_links", lambda edges, movers, targets: (sizes.append((edges.join(movers, "a", "left_anti").count(), edges.count())), real(edges, movers, targets))[1])
    edges = spark.createDataFrame([(i, j) for i in range(30) for j in range(30) if i != j], "a long, b long").selectExpr("a", "b", "1.0D AS w")
    nodes = community._node_table(edges)
    community._turns(edges, nodes, 870.0, 1, 2, 2)
    assert len(sizes) == 2 and all(still == 0 and some < 870 for still, some in sizes)
