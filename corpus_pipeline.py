"""The corpus pipeline: raw documents to token digests in five stages.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``, works on all rows that
its predecessor kept, and is written as Parquet in the shared scratch folder
before the next one reads it. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import bpe, mixing, neardup, registry, secrets, toxicity
from kgspark.runtime import discard, materialize, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go. The labels are those of the raw documents."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(spark, docs, model)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the least id."""
    return neardup.keep_first(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become marks; ``n_chars`` follows."""
    return secrets.redact_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the mix, range-partitioned by position, so the written files follow it."""
    prefix = f"mix_{uuid4().hex}_"  # no column of the documents has such a name
    placed, order = mixing.mixed(docs, registry.MIX, prefix=prefix), f"{prefix}position"
    return placed.repartitionByRange(order).sortWithinPartitions(order).select(*docs.columns)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document that is left."""
    return bpe.encode_documents(spark, docs, public_tokenizers.path(registry.RANKS), digest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("secret_scan", secret_redaction),
    ("source_mixing", source_mixing),
    ("byte_bpe", tokenization),
]

#: The classifier cannot be expressed in SQL; tests hold each stage against plain Python that shares no code with it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # the input itself is no such table and stays
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
