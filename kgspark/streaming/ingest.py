"""Ingestion of a folder of Markdown files as a stream: text to graph, all tables at once.

Each micro-batch replaces the documents that it brings: what their last version
gave is taken out (``incremental.delete_documents``), the new text is cut,
extracted and upserted, and the communities around what changed are moved by delta
screening. The tables of a batch become visible by one commit; a batch that comes
again after a stop changes nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.functions import text as T
from kgspark.operators import chunking, community, extraction, incremental
from kgspark.operators.clients import CapitalExtractor
from kgspark.runtime import discard, materialize
from kgspark.sources.files import watch_uploads
from kgspark.sources.tables import TableStore

#: The tables of the store.
SCHEMAS = {
    "documents": "id string, path string, content_hash string, version int, status string",
    "text_units": "id string, document_id string, ordinal int, text string",
    "mentions": "text_unit_id string, entity_id string",
    "entities": "id string, name string, type string, description string, confidence double, mention_count long",
    "relationships": "text_unit_id string, src string, dst string, rel_label string, confidence double",
    "claims": "claim_id string, text_unit_id string",
    "membership": "id string, community string",
}


class Ingest:
    """Brings batches of ``id, path, text, content_hash`` into a ``TableStore``."""

    def __init__(self, store: TableStore, types: list[str] | None = None, make: Callable = CapitalExtractor, settings: chunking.ChunkSettings = chunking.ChunkSettings()) -> None:
        self.store, self.types, self.make, self.settings = store, types or ["TERM"], make, settings

    def __call__(self, batch: DataFrame, number: int) -> None:
        """One micro-batch. Files with the stored hash are left alone; of two with one id the last hash counts."""
        if (done := self.store.state()["batch"]) is not None and number <= done:
            return
        newest = Window.partitionBy("id").orderBy(F.desc("content_hash"))
        rows = materialize(batch.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place"), "ingest-batch")
        t = {name: self.store.read(name) for name in SCHEMAS}
        diff = incremental.changed(rows, t["documents"]).where("is_changed")
        new = materialize(rows.join(diff.select("id", "version"), "id"), "ingest-new")
        if new.isEmpty():
            self.store.commit({}, number)
            discard(rows, new)
            return
        self.store.commit(self._changed_tables(new, t), number)
        discard(rows, new)

    def _changed_tables(self, new: DataFrame, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        again = new.select("id")
        left = incremental.delete_documents(again, t["text_units"], t["mentions"], t["entities"], t["claims"])
        units = materialize(chunking.chunk_documents(new.select("id", "text"), "id", "text", self.settings).select(F.col("chunk_id").alias("id"), "document_id", "ordinal", "text"), "ingest-units")
        found = materialize(extraction.extract_with_gleaning(units.select(F.col("id").alias("chunk_id"), "text"), self.types, make=self.make), "ingest-found")
        entity = found.where("kind = 'entity' and name is not null and trim(name) <> ''").withColumn("id", T.entity_id(F.col("name"), F.col("type")))
        mentions = materialize(entity.select(F.col("chunk_id").alias("text_unit_id"), F.col("id").alias("entity_id")).distinct(), "ingest-mentions")
        first = entity.groupBy("id").agg(*(F.min_by(c, F.struct("chunk_id", "seq")).alias(c) for c in ("name", "type", "description")), F.max("confidence").alias("confidence"), F.count_distinct("chunk_id").alias("mention_count"))
        old = left["entities"].select([F.col(c).alias(f"old_{c}") for c in left["entities"].columns])
        both = first.join(old, F.col("id") == F.col("old_id"), "full")
        entities = both.select(F.coalesce("old_id", "id").alias("id"), *(F.coalesce(f"old_{c}", c).alias(c) for c in ("name", "type", "description")), F.greatest("confidence", "old_confidence").alias("confidence"), (F.coalesce("mention_count", F.lit(0)) + F.coalesce("old_mention_count", F.lit(0))).cast("long").alias("mention_count"))
        entities = materialize(entities, "ingest-entities")
        names = entity.select("chunk_id", F.upper(F.trim("name")).alias("key"), "id").groupBy("chunk_id", "key").agg(F.min("id").alias("id"))
        edge = found.where("kind = 'relationship'").select("chunk_id", F.upper(F.trim("name")).alias("key"), F.upper(F.trim("target")).alias("other"), "confidence", F.coalesce("type", F.lit("RELATED_TO")).alias("rel_label"))
        edge = edge.join(names.withColumnRenamed("id", "src"), ["chunk_id", "key"]).join(names.select("chunk_id", F.col("key").alias("other"), F.col("id").alias("dst")), ["chunk_id", "other"])
        gone = t["text_units"].join(again.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select(F.col("id").alias("text_unit_id"))
        before = t["relationships"]
        lost = before.join(gone, "text_unit_id", "left_semi")
        added = materialize(edge.where("src <> dst").groupBy(F.col("chunk_id").alias("text_unit_id"), "src", "dst", "rel_label").agg(F.max("confidence").alias("confidence")), "ingest-edges")
        relationships = materialize(before.join(gone, "text_unit_id", "left_anti").unionByName(added), "ingest-relationships")
        touched = lost.select(F.explode(F.array("src", "dst")).alias("id")).union(added.select(F.explode(F.array("src", "dst")))).distinct()
        alive = entities.select("id")
        membership = community.detect_incrementally(relationships, t["membership"].join(alive, "id", "left_semi"), touched)
        documents = t["documents"].join(again, "id", "left_anti").unionByName(new.select("id", "path", "content_hash", F.col("version").cast("int").alias("version"), F.lit("completed").alias("status")))
        return {
            "documents": documents, "text_units": left["text_units"].unionByName(units), "mentions": left["mentions"].unionByName(mentions), "entities": entities,
            "relationships": relationships, "claims": left["claims"], "membership": membership,
        }


def ingest_folder(folder: str, store: TableStore, checkpoint: str, ingest: Ingest | None = None) -> StreamingQuery:
    """Starts the stream over ``folder`` until all files are in."""
    return watch_uploads(store.spark, folder, ingest or Ingest(store), checkpoint)
