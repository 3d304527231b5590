"""A result cache as a table: keys, JSON values and the time they were stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ResultCache:
    ttl_seconds: int = 3600

    def live(self, rows: DataFrame, now: Column) -> DataFrame:
        """Rows stored up to ``now`` whose time to live has not passed."""
        age = F.make_dt_interval(secs=F.lit(self.ttl_seconds))
        return rows.where((F.col("stored_at") <= now) & (F.col("stored_at") + age > now))

    def put(self, rows: DataFrame, new: DataFrame) -> DataFrame:
        """``rows`` with the keys of ``new`` replaced."""
        return rows.join(new.select("key"), "key", "left_anti").unionByName(new)

    def clear(self, rows: DataFrame, prefix: str) -> DataFrame:
        return rows.where(~F.col("key").startswith(prefix))

    def prefix_counts(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.split("key", ":")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
