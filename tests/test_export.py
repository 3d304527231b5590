"""The export sink: round trip, one document, and an export that fails."""

import json

import pytest
from pyspark.sql import functions as F

from kgspark.sources import export


def sample(spark):
    nodes = spark.createDataFrame([("Entity", "a", 'quo"te\nline', 1, ["x"]), ("Entity", "b", None, None, None), ("Document", "é", "", 2, [])], "label string, id string, name string, n int, tags array<string>")
    edges = spark.createDataFrame([("a", "b", "KNOWS", 0.5)], "src string, dst string, rel_label string, confidence double")
    return nodes, edges


def test_round_trip_and_one_document(spark, tmp_path):
    nodes, edges = sample(spark)
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # the second takes the place of the first
        manifest = export.write_export(nodes, edges, folder)
        assert manifest["stats"] == {"labels": ["Document", "Entity"], "relationshipTypes": ["KNOWS"], "nodeCount": 3, "relationshipCount": 1}
    back = export.read_export(spark, folder)
    assert sorted(map(tuple, back["nodes"].collect()), key=repr) == sorted(map(tuple, nodes.collect()), key=repr)
    assert back["nodes"].schema == nodes.schema and back["relationships"].collect() == edges.collect()
    whole = json.loads("".join(export.document(spark, folder)))
    assert set(whole) == {"meta", "stats", "nodes", "relationships"} and whole["meta"]["version"] == 1
    assert sorted(x["id"] for x in whole["nodes"]) == ["a", "b", "é"] and whole["relationships"][0]["rel_label"] == "KNOWS"


def test_a_failed_task_leaves_the_last_export(spark, tmp_path):
    nodes, edges = sample(spark)
    folder = f"file://{tmp_path}/out"
    first = export.write_export(nodes, edges, folder)
    broken = edges.withColumn("confidence", F.when(F.col("src") == "a", F.raise_error(F.lit("lost"))).cast("double"))
    with pytest.raises(Exception, match="lost"):
        export.write_export(nodes.limit(1), broken, folder)
    assert export.read_manifest(spark, folder) == first and export.read_export(spark, folder)["nodes"].count() == 3
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 1


def test_empty_graph(spark, tmp_path):
    nodes, edges = sample(spark)
    folder = f"file://{tmp_path}/none"
    assert export.write_export(nodes.where("false"), edges.where("false"), folder)["stats"]["nodeCount"] == 0
    assert json.loads("".join(export.document(spark, folder)))["nodes"] == []
    assert export.read_export(spark, folder)["relationships"].count() == 0
