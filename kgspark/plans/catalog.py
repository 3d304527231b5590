"""All registered queries of the reference operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of ``kgspark.plans`` that define QUERIES and SQL.
MODULES: tuple[str, ...] = ("star", "texts", "ranking", "answers")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"kgspark.plans.{name}"), attribute)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {clash}")
        out |= part
    return out


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.plans import star

    return star.flagship(spark, sf_dir)
