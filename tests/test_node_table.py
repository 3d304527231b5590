"""Stored node tables: one bucket a lookup, joins without shuffle, keys that stay unique."""

import re

import pytest

from kgspark.sources.nodes import DuplicateKeyError, NodeTable


def rows(spark, ids):
    return spark.createDataFrame([(f"n{i}", f"name {i}") for i in ids], "id string, name string")


def test_lookup_reads_one_bucket_and_keys_stay_unique(spark, tmp_path):
    table = NodeTable(spark, "node_table_test", f"file://{tmp_path}/nodes", buckets=8)
    table.create(rows(spark, range(200)))
    try:
        # with this setting the plan names the buckets; without it the same files are left out by their bucket numbers
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = table.lookup("n17")._jdf.queryExecution().explainString(formatted)
        assert re.search(r"SelectedBucketsCount: 1 out of 8", plan)
        assert [tuple(r) for r in table.lookup("n17").collect()] == [("n17", "name 17")] and table.lookup("none").count() == 0
        table.insert(rows(spark, range(200, 220)))
        assert table.read().count() == 220
        for bad in ([5, 900], [901, 901]):
            with pytest.raises(DuplicateKeyError):
                table.insert(rows(spark, bad))
        with pytest.raises(DuplicateKeyError):
            table.insert(spark.createDataFrame([(None, "x")], "id string, name string"))
        assert table.read().count() == 220 and table.lookup("n900").count() == 0
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = table.read().join(table.read().withColumnRenamed("name", "other"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 220
    finally:
        for name in ("autoBroadcastJoinThreshold", "sources.bucketing.autoBucketedScan.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.sql("DROP TABLE node_table_test")


def test_rows_with_repeated_keys_make_no_table(spark, tmp_path):
    table = NodeTable(spark, "node_table_none", f"file://{tmp_path}/none", buckets=4)
    with pytest.raises(DuplicateKeyError):
        table.create(rows(spark, [1, 1]))
    assert not spark.catalog.tableExists("node_table_none") and not (tmp_path / "none").exists()
