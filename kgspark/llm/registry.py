"""The training-data queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kgspark.runtime import table

from . import ann, bpe, decontaminate, divergence, media, mixing, neardup, secrets, spelling, suffixtree, toxicity, unigram, urlfilter

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: Production mix: a heavy source is held to a tenth, two curated ones are raised, unlisted sources share a twentieth.
MIX = mixing.Mix({"src0": 0.10, "src1": 0.08, "src2": 0.08} | {f"src{i}": 0.04 for i in range(3, 20)}, other=0.05)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = mixing.mixed(docs, MIX)
    return out.withColumnsRenamed({c: c.removeprefix("mix_") for c in out.columns})


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score_documents(spark, table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspect_media(media.encode_media(table(spark, sf_dir, "documents")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(spark, docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), digest=True)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spark, table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle_sql(MIX), "op6_jaccard_join": neardup.ORACLE_SQL, "op11_divergence": divergence.ORACLE_SQL, "op12_decontaminate": decontaminate.ORACLE_SQL}
