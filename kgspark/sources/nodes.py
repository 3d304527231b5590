"""Stored node tables: bucketed and sorted by key, with Bloom filters, and no key twice.

A point lookup reads one bucket, of which file statistics and Bloom filters leave
few row groups; joins on the key of tables with equal buckets need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """An insert brings a key that is there already, or the same key twice."""


class NodeTable:
    """A catalog table of rows with a unique ``key``; its files lie in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, name: str, folder: str, key: str = "id", buckets: int = 64) -> None:
        self.spark, self.name, self.folder, self.key, self.buckets = spark, name, folder, key, buckets

    def _save(self, rows: DataFrame, mode: str) -> None:
        # rows of one bucket meet in one task, so a bucket gets one file a write
        dealt = rows.repartition(self.buckets, self.key)
        writer = dealt.write.mode(mode).format("parquet").option("path", self.folder).option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        writer.bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name)

    def create(self, rows: DataFrame) -> None:
        """The table with ``rows``; an error, and no table, if keys repeat or are null."""
        self._check(rows)
        self._save(rows, "errorifexists")

    def _check(self, rows: DataFrame) -> None:
        repeated = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(self.key).isNull())
        if found := repeated.limit(5).collect():
            raise DuplicateKeyError(f"keys repeated or null in the rows: {sorted(str(r[self.key]) for r in found)}")

    def insert(self, rows: DataFrame) -> None:
        """Append ``rows``; an error, and the table as it was, if a key is there already, repeats or is null."""
        self._check(rows)
        known = self.read().select(self.key).join(rows.select(self.key), self.key, "left_semi")
        if found := known.limit(5).collect():
            raise DuplicateKeyError(f"keys in the table already: {sorted(str(r[self.key]) for r in found)}")
        self._save(rows.select(*self.read().columns), "append")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, value: object) -> DataFrame:
        """The row of one key, or none."""
        return self.read().where(F.col(self.key) == F.lit(value))
