"""Incremental maintenance by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """``id, content_hash, version, is_changed``: a missing or different hash is a change; ``force`` nulls the stored hash."""
    old = stored.select("id", F.lit(None).cast("string").alias("old_hash") if force else F.col("content_hash").alias("old_hash"), "version")
    both = incoming.select("id", "content_hash").join(old, "id", "left")
    diff = ~F.col("content_hash").eqNullSafe(F.col("old_hash")) | F.col("old_hash").isNull()
    return both.select("id", "content_hash", (F.coalesce("version", F.lit(0)) + diff.cast("int")).alias("version"), diff.alias("is_changed"))


def mentions_of(documents: DataFrame, text_units: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions in the text units of the documents (one-column table)."""
    d = documents.select(F.col(documents.columns[0]).alias("document_id"))
    units = text_units.join(d, "document_id", "left_semi").select(F.col("id").alias("text_unit_id"))
    return mentions.join(units, "text_unit_id", "left_semi")


def orphans(documents: DataFrame, text_units: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that only these documents mention: ``entity_id``."""
    gone = mentions_of(documents, text_units, mentions)
    rest = mentions.join(gone, ["text_unit_id", "entity_id"], "left_anti")
    return gone.select("entity_id").distinct().join(rest.select("entity_id").distinct(), "entity_id", "left_anti")


def delete_documents(documents: DataFrame, text_units: DataFrame, mentions: DataFrame, entities: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents: claims and mentions from their text units go, orphans go, other counts fall by one a mention, not below 1."""
    gone = mentions_of(documents, text_units, mentions)
    lost = gone.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    left = entities.join(orphans(documents, text_units, mentions).withColumnRenamed("entity_id", "id"), "id", "left_anti").join(lost, "id", "left")
    d = documents.select(F.col(documents.columns[0]).alias("document_id"))
    units = text_units.join(d, "document_id", "left_semi").select(F.col("id").alias("text_unit_id"))
    return {
        "entities": left.withColumn("mention_count", F.greatest(F.col("mention_count") - F.coalesce("n", F.lit(0)), F.lit(1))).drop("n"),
        "mentions": mentions.join(units, "text_unit_id", "left_anti"),
        "claims": claims.join(units, "text_unit_id", "left_anti"),
        "text_units": text_units.join(d, "document_id", "left_anti"),
    }


def affected_communities(documents: DataFrame, text_units: DataFrame, mentions: DataFrame, membership: DataFrame) -> DataFrame:
    """``community, n_entities`` of communities with an entity that the documents mention."""
    ids = mentions_of(documents, text_units, mentions).select(F.col("entity_id").alias("id")).distinct()
    return membership.join(ids, "id").groupBy("community").agg(F.count_distinct("id").alias("n_entities"))
