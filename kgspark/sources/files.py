"""File sources and sinks: Markdown folders, upload streams, JSON export, logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.runtime import scratch_dir


def has_extension(path: Column, extension: str = "md") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./?#]+)$", 1)) == extension


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of every ``.md`` file below ``folder``, whole files."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def watch_uploads(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``handle(batch, number)`` with ``id, path, text, content_hash, status`` of new Markdown files.

    Exactly-once needs ``handle`` to be idempotent by (path, content_hash).
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").load(folder)
    rows = stream.select(F.md5(F.col("path").cast("binary")).alias("id"), "path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("content_hash"), F.lit("processing").alias("status"))
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line a node, an edge and a statistic: ``section, json``."""
    part = lambda name, df: df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))
    stats = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("relationships")))
    return part("nodes", nodes).unionAll(part("relationships", edges)).unionAll(part("stats", stats))


def append_log(log: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows`` appended as Parquet to the log's folder; a new folder in the scratch space for the first."""
    spark = rows.sparkSession
    path = log.inputFiles()[0].rsplit("/", 1)[0] if log is not None else f"{scratch_dir(spark)}/kgspark/log-{uuid.uuid4().hex}"
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
