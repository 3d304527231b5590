"""Analytics over a log of reasoning queries.

Log columns: id, ts, status, method, processing_time_ms, confidence_score and
the arrays steps, triplets, entities and relations as counts where noted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def query_metrics(log: DataFrame, max_depth: str = "search_depth") -> DataFrame:
    """Per query: totals, ratios by step, efficiency = triplets / entities, share of the allowed depth. Divisions by 0 give 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return log.select(
        "id",
        F.col("n_steps").alias("total_steps"),
        F.col("n_triplets").alias("total_triplets"),
        ratio("n_entities", "n_steps").alias("entities_per_step"),
        ratio("n_relations", "n_steps").alias("relations_per_step"),
        ratio("n_triplets", "n_entities").alias("efficiency"),
        ratio("n_steps", max_depth).alias("depth_utilisation"),
    )


def p95(values: Column) -> Column:
    """Exclusive 95th percentile (20 quantiles) of a group; the mean below 20 values."""
    x = F.array_sort(F.collect_list(values))
    m = F.size(x)
    j = F.greatest(F.lit(1), F.least(F.floor(19 * (m + 1) / 20), m - 1)).cast("int")
    rest = 19 * (m + 1) - 20 * j
    return F.when(m < 20, F.avg(values)).otherwise((F.element_at(x, j) * (20 - rest) + F.element_at(x, j + 1) * rest) / 20)


def p95_ranked(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """The same for groups of any size: two order statistics by rank; no group is collected or sorted in one task."""
    keys = list(group)
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v")), [*keys, "v"])
    sized = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.avg("v").alias("mean"), F.min("r").alias("start"))
    m, j = F.col("m"), F.col("j")
    sized = sized.withColumn("j", F.greatest(F.lit(1), F.least(F.floor(19 * (m + 1) / 20), m - 1)))
    # the ranks asked for, two a group, meet the rows by their numbers, which no two rows share
    wanted = sized.select(*[F.col(k).alias(f"key_{k}") for k in keys], "m", "j", "mean", F.explode(F.array(F.col("start") + j - 1, F.col("start") + F.least(j, m - 1))).alias("r"), "start")
    met = wanted.join(placed.select("r", "v"), "r").groupBy(*[f"key_{k}" for k in keys], "m", "j", "mean").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    rest = 19 * (m + 1) - 20 * j
    return met.select(*[F.col(f"key_{k}").alias(k) for k in keys], F.when(m < 20, F.col("mean")).otherwise((F.col("low") * (20 - rest) + F.col("high") * rest) / 20).alias("p95"))


def aggregate_metrics(log: DataFrame) -> DataFrame:
    """One row over the log; zeros for an empty one."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return log.agg(
        F.count(F.lit(1)).alias("n_queries"),
        zero(F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0))).alias("success_rate"),
        zero(F.avg("processing_time_ms")).alias("mean_ms"),
        zero(F.min("processing_time_ms")).alias("min_ms"),
        zero(F.max("processing_time_ms")).alias("max_ms"),
        zero(F.avg(F.when(F.col("confidence_score") > 0, F.col("confidence_score")))).alias("mean_confidence"),
    )


def status_mode(log: DataFrame) -> DataFrame:
    """Most frequent status, the first seen by ``seq`` on ties."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(1).select("status", "n")


def usage(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, value: str, bins: int = 5, inclusive: bool = False) -> DataFrame:
    """``bin, label, n``: half-open bins of equal width; the largest value counts only if ``inclusive``.

    Equal values make one bin; empty bins have no row.
    """
    v = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    edges = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = v.crossJoin(F.broadcast(edges)).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    b = F.when(F.col("hi") == F.col("lo"), 0).when(F.col("v") < F.col("hi"), F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1)))
    b = F.coalesce(b, F.lit(bins - 1)) if inclusive else b
    counted = at.withColumn("bin", b.cast("int")).where("bin is not null").groupBy("bin", "lo", "w").agg(F.count(F.lit(1)).alias("n"))
    low, high = F.col("lo") + F.col("bin") * F.col("w"), F.col("lo") + (F.col("bin") + 1) * F.col("w")
    return counted.select("bin", F.format_string("%.2f-%.2f", low, high).alias("label"), "n")


def trend(rows: DataFrame, value: str, order: list[str], floor: float = 0.001, stable: float = 0.05) -> DataFrame:
    """Mean of the first and the second half in ``order``; under 5 % relative change is stable."""
    placed = numbered(rows.select(*order, F.col(value).alias("v")), order)
    half = F.floor(F.lit(placed.count()) / 2)
    halves = placed.agg(F.avg(F.when(F.col("r") <= half, F.col("v"))).alias("first"), F.avg(F.when(F.col("r") > half, F.col("v"))).alias("second"))
    change = (F.col("second") - F.col("first")) / F.greatest(F.abs("first"), F.lit(floor))
    return halves.select("first", "second", F.when(F.abs(change) < stable, "stable").when(change > 0, "increasing").otherwise("decreasing").alias("trend"))


def insights(mean_ms: Column, mean_steps: Column, success: Column, llm_ms: Column, bm25_ms: Column) -> Column:
    """Findings whose thresholds are passed, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(mean_ms > 5000, F.lit("slow average response")),
            F.when(mean_steps > 3, F.lit("many reasoning steps")),
            F.when(success < 0.9, F.lit("low success rate")),
            F.when(llm_ms > 2 * bm25_ms, F.lit("llm pruning is slow")),
        )
    )


def look_back(log: DataFrame, now: Column, hours: float, cap: int = 1000, order: str = "seq") -> DataFrame:
    """The newest ``cap`` rows of the last ``hours`` before ``now``; the cap is the feature's report size."""
    return log.where(F.col("ts") > now - F.make_dt_interval(F.lit(0), F.lit(hours).cast("int"))).orderBy(F.desc("ts"), F.desc(order)).limit(cap)
