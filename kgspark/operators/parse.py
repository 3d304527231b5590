"""Parsers at the language-model boundary: delimited tuples and JSON replies."""


import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgspark.functions import text as T

#: Delimiters of the two tuple formats (fixed values).
GRAPH_FIELD, GRAPH_END = "|||", "<COMPLETE>"
CLAIM_FIELD, CLAIM_RECORD, CLAIM_END = "<|>", "##", "<|COMPLETE|>"
RECORD = "kind string, name string, type string, target string, description string, confidence double, strength double"

CLAIM = "subject string, object string, claim_type string, status string, start_date string, end_date string, description string, source_text string"


def graph_records(reply: str) -> Iterator[tuple]:
    """Records of a graph reply: (kind, name, type, target, description, confidence, strength).

    A record may span lines: a line that opens no tuple continues the one before.
    Entities need four fields, relationships five; others are dropped.
    """
    body = reply.split(GRAPH_END)[0]
    records: list[str] = []
    for line in (x.strip() for x in body.splitlines()):
        if not line or line.startswith("```"):
            continue
        if line.startswith("(") or not records:
            records.append(line)
        else:
            records[-1] += " " + line
    for record in records:
        fields = [f.strip().strip('"').strip() for f in record.strip().removeprefix("(").removesuffix(")").split(GRAPH_FIELD)]
        kind = fields[0].lower()
        if kind == "entity" and len(fields) >= 4 and fields[1]:
            yield "entity", fields[1], fields[2].upper(), None, fields[3], 0.8, None
        elif kind == "relationship" and len(fields) >= 5:
            try:
                strength = float(fields[4])
            except ValueError:
                strength = 5.0
            yield "relationship", fields[1], "RELATED_TO", fields[2], fields[3], max(0.0, min(strength / 10, 1.0)), strength


def parse_graph_replies(replies: DataFrame, id_col: str = "chunk_id", reply_col: str = "reply") -> DataFrame:
    """One row for each record, with its place ``seq`` in the reply. Null replies have none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, *r) for i, reply in zip(pdf[id_col], pdf[reply_col], strict=True) for k, r in enumerate(graph_records(reply or ""))]
            out = pd.DataFrame(rows, columns=[id_col, "seq", "kind", "name", "type", "target", "description", "confidence", "strength"])
            yield out.astype({"seq": "int32", "confidence": "float64", "strength": "float64"})

    return replies.select(F.col(id_col).cast("string").alias(id_col), reply_col).mapInPandas(run, f"{id_col} string, seq int, {RECORD}")


def parse_graph_lines(replies: DataFrame, id_col: str = "chunk_id", reply_col: str = "reply") -> DataFrame:
    """The same for replies with one record a line, in the JVM."""
    body = F.substring_index(F.col(reply_col), GRAPH_END, 1)
    lines = replies.select(id_col, F.posexplode(F.split(body, "\n")).alias("seq", "line"))
    fields = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\(|\)$", ""), r"\|\|\|"), lambda f: F.trim(F.regexp_replace(F.trim(f), r'^"|"$', "")))
    rows = lines.withColumn("f", fields).withColumn("kind", F.lower(F.col("f")[0]))
    entity = (F.col("kind") == "entity") & (F.size("f") >= 4)
    relation = (F.col("kind") == "relationship") & (F.size("f") >= 5)
    at = lambda i: F.get("f", F.lit(i))
    strength = F.when(relation, F.coalesce(at(4).try_cast("double"), F.lit(5.0)))
    return rows.where(entity | relation).select(
        id_col,
        "seq",
        "kind",
        at(1).alias("name"),
        F.when(entity, F.upper(at(2))).otherwise("RELATED_TO").alias("type"),
        F.when(relation, at(2)).alias("target"),
        at(3).alias("description"),
        F.when(entity, F.lit(0.8)).otherwise(T.scaled_strength(at(4))).alias("confidence"),
        strength.alias("strength"),
    )


def claim_records(reply: str) -> Iterator[tuple]:
    """``seq`` and the eight fields of each claim of a reply, as ``parse_claims`` reads them."""
    for seq, record in enumerate(reply.split(CLAIM_END)[0].split(CLAIM_RECORD)):
        if "(" not in record or CLAIM_FIELD not in record:
            continue
        inner = re.search(r"\((.*?)\)?\s*$", record, re.DOTALL | re.ASCII)[1]
        f = [x.strip(" ") for x in inner.split(CLAIM_FIELD)]
        if len(f) >= 8:
            start, end = (x if x.upper() != "NONE" else None for x in f[4:6])
            yield seq, f[0], f[1], f[2].upper(), f[3].upper(), start, end, f[6], f[7]


def parse_claims(replies: DataFrame, id_col: str = "chunk_id", reply_col: str = "reply") -> DataFrame:
    """Claims of eight fields; fewer are rejected, NONE dates are null, a missing ``)`` is tolerated."""
    body = F.substring_index(F.col(reply_col), CLAIM_END, 1)
    records = replies.select(id_col, F.posexplode(F.split(body, CLAIM_RECORD)).alias("seq", "record")).where(F.col("record").contains("(") & F.col("record").contains(CLAIM_FIELD))
    inner = F.regexp_extract("record", r"(?s)\((.*?)\)?\s*$", 1)
    fields = F.transform(F.split(inner, r"<\|>"), lambda f: F.trim(f))
    rows = records.withColumn("f", fields).where(F.size("f") >= 8)
    at = lambda i: F.col("f")[i]
    date = lambda i: F.when(F.upper(at(i)) != "NONE", at(i))
    return rows.select(id_col, "seq", at(0).alias("subject"), at(1).alias("object"), F.upper(at(2)).alias("claim_type"), F.upper(at(3)).alias("status"), date(4).alias("start_date"), date(5).alias("end_date"), at(6).alias("description"), at(7).alias("source_text"))


def parse_json(reply: Column, schema: StructType | str) -> Column:
    """The reply as a struct after removing fences and control characters; null fields where it does not fit."""
    return F.from_json(T.scrub(T.strip_fence(reply)), schema, {"mode": "PERMISSIVE"})


def repair_json(reply: str) -> str:
    """JSON text with raw line breaks and tabs inside strings escaped and trailing commas removed."""
    escaped = re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: m[0].replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"), reply, flags=re.DOTALL)
    return re.sub(r",(\s*[}\]])", r"\1", escaped)


def repaired_json(replies: DataFrame, reply_col: str = "reply", out: str = "json") -> DataFrame:
    """``out``: the reply if it is JSON, else its repaired form if that is, else ``{}``."""

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str:
            for candidate in (x or "", repair_json(x or "")):
                try:
                    json.loads(candidate)
                except ValueError:
                    continue
                return candidate
            return "{}"

        return s.map(one)

    return replies.withColumn(out, fix(T.scrub(T.strip_fence(F.col(reply_col)), wide=True)))
