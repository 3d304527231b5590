"""Extraction passes, in-chunk deduplication and question routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parse
from .clients import CapitalExtractor, Embedder, Extractor, HashEmbedder


def extract_with_gleaning(chunks: DataFrame, types: list[str], passes: int = 1, make: Callable[[], Extractor] = CapitalExtractor) -> DataFrame:
    """Records of a first pass and up to ``passes`` more over what was missed.

    Between passes, not after the last, the extractor is asked whether anything
    is missing and stops unless it answers yes. One extractor a partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make()
        for pdf in batches:
            rows = []
            for chunk, text in zip(pdf["chunk_id"], pdf["text"], strict=True):
                found = list(parse.graph_records(extractor.extract(text or "", types, [])))
                for n in range(passes):
                    known = [r[1] for r in found if r[0] == "entity"]
                    found += parse.graph_records(extractor.extract(text or "", types, known))
                    if n < passes - 1 and "Y" not in extractor.more(text or "", known).upper():
                        break
                rows += [(chunk, k, *r) for k, r in enumerate(found)]
            out = pd.DataFrame(rows, columns=["chunk_id", "seq", "kind", "name", "type", "target", "description", "confidence", "strength"])
            yield out.astype({"seq": "int32", "confidence": "float64", "strength": "float64"})

    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id string, seq int, {parse.RECORD}")


def dedup_entities(entities: DataFrame, *group: str) -> DataFrame:
    """One row for each upper-case (name, type) of a ``group`` (such as chunk_id).

    The first spelling stays; confidence is the running pairwise mean in order of
    ``seq``; distinct non-blank descriptions are joined in sorted order.
    """
    keys = [*(F.col(g) for g in group), F.upper(F.trim("name")).alias("key_name"), F.upper("type").alias("key_type")]
    ordered = F.array_sort(F.collect_list(F.struct("seq", "confidence")))
    mean = F.aggregate(F.slice("ordered", 2, F.size("ordered")), F.col("ordered")[0]["confidence"], lambda m, x: (m + x["confidence"]) / 2)
    described = F.array_sort(F.collect_set(F.when(F.trim("description") != "", F.trim("description"))))
    out = entities.groupBy(*keys).agg(
        F.min_by("name", "seq").alias("name"),
        F.min_by("type", "seq").alias("type"),
        F.array_join(described, " | ").alias("description"),
        F.count(F.lit(1)).alias("mention_count"),
        ordered.alias("ordered"),
    )
    return out.select(*group, "name", "type", "description", F.round(mean, 2).alias("confidence"), "mention_count")


def dedup_relationships(relations: DataFrame, *group: str) -> DataFrame:
    """One row for each upper-case (name, target, type): largest strength and confidence, weight = rows."""
    keys = [*(F.col(g) for g in group), F.upper(F.trim("name")).alias("k1"), F.upper(F.trim("target")).alias("k2"), F.upper("type").alias("k3")]
    out = relations.groupBy(*keys).agg(
        F.min_by("name", "seq").alias("source"),
        F.min_by("target", "seq").alias("target"),
        F.min_by("type", "seq").alias("type"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.trim("description") != "", F.trim("description")))), " | ").alias("description"),
        F.max("strength").alias("strength"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("weight"),
    )
    return out.drop("k1", "k2", "k3")


def between_known(relations: DataFrame, entities: DataFrame, source: str = "source", target: str = "target", name: str = "name") -> DataFrame:
    """Relationships whose non-empty ends are both known names, by trimmed upper case."""
    known = entities.select(F.upper(F.trim(name)).alias("known")).distinct()
    out = relations.where((F.trim(source) != "") & (F.trim(target) != ""))
    for end in (source, target):
        out = out.join(known, F.upper(F.trim(F.col(end))) == F.col("known"), "left_semi")
    return out


def with_entities(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Chunks in which an entity was found."""
    return chunks.join(entities.select("chunk_id").distinct(), "chunk_id", "left_semi")


def consolidated(descriptions: Column) -> Column:
    """None: empty text; one: itself; several: joined in order (a generator may rewrite them)."""
    return F.when(F.size(descriptions) <= 0, F.lit("")).otherwise(F.array_join(descriptions, " "))


def consolidate_descriptions(entities: DataFrame) -> DataFrame:
    """Across chunks: one description for each upper-case (name, type)."""
    found = F.array_sort(F.collect_set(F.when(F.trim("description") != "", F.trim("description"))))
    return entities.groupBy(F.upper("name").alias("name_key"), F.upper("type").alias("type_key")).agg(found.alias("found")).select("name_key", "type_key", F.size("found").cast("int").alias("n_descriptions"), consolidated(F.col("found")).alias("description"))


def embed(rows: DataFrame, text_col: str = "text", make: Callable[[], Embedder] = HashEmbedder, out: str = "embedding") -> DataFrame:
    """``rows`` with a vector for each non-blank text, null for the others."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = make()
        for s in batches:
            yield s.map(lambda t: e.embed(t) if t and t.strip() else None)

    return rows.withColumn(out, vectors(F.col(text_col).cast("string")))


def classify_question(question: Column) -> Column:
    """Route of a question by its words: global, local, tog or hybrid (fixed rules)."""
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(overall|summar\w*|themes?|trends?|overview)\b"), "global")
        .when(q.rlike(r"\b(why|how|relat\w*|connect\w*|between|path)\b"), "tog")
        .when(q.rlike(r"\b(who|what|where|when|which)\b"), "local")
        .otherwise("hybrid")
    )
