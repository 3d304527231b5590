"""Consecutive numbers in a total order, without one task for all rows."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.runtime import discard, materialize


def numbered(rows: DataFrame, order: list[str], name: str = "r") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in ascending ``order`` (nulls first); equal rows are in some order.

    Rows are range-partitioned by ``order``, numbered inside each partition and
    moved up by the counts of the partitions before: one number a partition is
    all that the driver sees. Equal rows are told apart by a number of their
    own, which is written first, so a value that most rows have is spread over
    many partitions.
    """
    part, own = f"part_{uuid4().hex}", f"own_{uuid4().hex}"
    marked = materialize(rows.withColumn(own, F.monotonically_increasing_id()), "numbered")
    # a stated number of ranges: adaptive execution would merge those that it is free to choose
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(marked.repartitionByRange(ranges, *order, own).withColumn(part, F.spark_partition_id()), "numbered")
    discard(marked)
    counts = {r[part]: r["count"] for r in placed.groupBy(part).count().collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    first = F.split(F.lit(",".join(map(str, before or [0]))), ",").cast("array<long>")
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order, own))
    return placed.withColumn(name, F.element_at(first, F.col(part) + 1) + inside).drop(part, own)
