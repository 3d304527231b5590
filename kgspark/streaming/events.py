"""Streaming extensions on the query log: windows with watermarks, deduplication, batch ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.runtime import scratch_dir, scratch_folder


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, event time as TIMESTAMP."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling or sliding window and type, late rows dropped after ``late``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    out = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "user_id", "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a query over all that is there and return its rows.

    Appended rows go from the executors to files in the scratch folder. Other
    modes change rows that are out, which files cannot, and are kept in the
    driver's memory: for small results.
    """
    spark = stream.sparkSession
    if mode != "append":
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)
    path = scratch_folder(spark, f"stream-{name}")
    query = stream.writeStream.format("parquet").queryName(name).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], tag: str) -> StreamingQuery:
    """``foreachBatch`` with a checkpoint in the shared scratch folder."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{scratch_dir(stream.sparkSession)}/kgspark/stream-{tag}").trigger(availableNow=True).start()
