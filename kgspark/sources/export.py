"""JSON export of a graph: shards that Spark writes, made visible by one manifest.

``<folder>/run-<id>/nodes`` and ``.../relationships`` hold JSON lines;
``<folder>/manifest.json`` (meta, stats and the sections with their schemas) is
written last and takes the place of the one before by one rename. An export that
fails leaves no manifest of its own, so readers still see the last whole one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1


def _hadoop(spark: SparkSession, folder: str):  # noqa: ANN202
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return fs, conf, fs.Path(folder).getFileSystem(conf)


def write_export(nodes: DataFrame, relationships: DataFrame, folder: str, tool: str = "kgspark") -> dict:
    """Exports nodes (``label`` and any columns) and relationships (``rel_label`` and any columns); returns the manifest.

    Columns that are null in a row are left out of its line and read back as
    null. Counts and label lists are taken from what was written.
    """
    spark, folder = nodes.sparkSession, folder.rstrip("/")
    paths, conf, system = _hadoop(spark, folder)
    run = f"run-{uuid.uuid4().hex}"
    sections = {"nodes": (nodes, "label"), "relationships": (relationships, "rel_label")}
    try:
        listed, counts = {}, {}
        for name, (rows, kind) in sections.items():
            rows.write.json(f"{folder}/{run}/{name}")
            kinds = spark.read.schema(rows.schema).json(f"{folder}/{run}/{name}").groupBy(kind).count().collect()  # one row a label
            listed[name], counts[name] = sorted(r[kind] for r in kinds if r[kind] is not None), sum(r["count"] for r in kinds)
        manifest = {
            "meta": {"exportedAt": datetime.now(UTC).isoformat(), "tool": tool, "version": VERSION},
            "stats": {"labels": listed["nodes"], "relationshipTypes": listed["relationships"], "nodeCount": counts["nodes"], "relationshipCount": counts["relationships"]},
            "sections": {name: {"path": f"{run}/{name}", "schema": rows.schema.jsonValue()} for name, (rows, _) in sections.items()},
        }
        draft = paths.Path(f"{folder}/{run}/manifest.json")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        out.close()
        rename = paths.Options.Rename if hasattr(paths.Options, "Rename") else getattr(paths, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        target = paths.Path(f"{folder}/manifest.json")
        paths.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else system.getUri(), conf).rename(draft, target, options)
    except Exception:
        system.delete(paths.Path(f"{folder}/{run}"), True)
        raise
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder.rstrip('/')}/manifest.json", wholetext=True).first()[0])


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The sections of the last whole export, with the columns and types that were written."""
    sections = read_manifest(spark, folder)["sections"]
    return {name: spark.read.schema(StructType.fromJson(s["schema"])).json(f"{folder.rstrip('/')}/{s['path']}") for name, s in sections.items()}


def document(spark: SparkSession, folder: str) -> Iterator[str]:
    """The export as the text of one JSON document (meta, stats, nodes, relationships), piece by piece.

    For a client that wants one file: it holds one partition of rows at a time.
    """
    manifest = read_manifest(spark, folder)
    yield '{"meta": ' + json.dumps(manifest["meta"]) + ', "stats": ' + json.dumps(manifest["stats"], ensure_ascii=False)
    for name, rows in read_export(spark, folder).items():
        yield f', "{name}": ['
        for k, row in enumerate(rows.select(F.to_json(F.struct(*rows.columns)).alias("line")).toLocalIterator()):
            yield (", " if k else "") + row["line"]
        yield "]"
    yield "}"
