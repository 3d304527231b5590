"""Registration of queries, and the test graph on the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries of a module and their DuckDB SQL."""

    def __init__(self, prelude: str = "") -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.prelude = prelude

    def __call__(self, name: str, sql: str | None = None, prelude: bool = True) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                head = self.prelude if prelude else ""
                body = sql.strip()
                if head and body.upper().startswith("WITH RECURSIVE"):
                    head, body = head.replace("WITH ", "WITH RECURSIVE ", 1), body[len("WITH RECURSIVE") :]
                    self.sql[name] = head + ",\n" + body
                elif head and body.upper().startswith("WITH "):
                    self.sql[name] = head + ",\n" + body[len("WITH ") :]
                else:
                    self.sql[name] = head + "\n" + body
            return f

        return register


class Star:
    """Documents, text units, entities, mentions, relationships and claims on the star schema.

    customer = document, orders = text unit, part, supplier, nation and region =
    entities, lineitem = mentions, relationships and claims.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.t = lambda name: table(spark, sf_dir, name)

    def entities(self) -> DataFrame:
        line = self.t("lineitem")
        n_part = line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
        n_supp = line.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
        cols = lambda p, key, name, kind, text, conf, n: [F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), kind.alias("type"), text.alias("description"), conf.cast("double").alias("confidence"), n.cast("long").alias("mention_count")]
        one, count = F.lit(1), F.coalesce("n", F.lit(1))
        part = self.t("part").join(n_part, F.col("p_partkey") == F.col("l_partkey"), "left").select(*cols("P", "p_partkey", "p_name", F.col("p_type"), F.col("p_brand"), F.col("p_size") / 50, count))
        supp = self.t("supplier").join(n_supp, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(*cols("S", "s_suppkey", "s_name", F.lit("SUPPLIER"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.lit(0.8), count))
        nation = self.t("nation").select(*cols("N", "n_nationkey", "n_name", F.lit("NATION"), F.col("n_name"), F.lit(0.9), one))
        region = self.t("region").select(*cols("R", "r_regionkey", "r_name", F.lit("REGION"), F.col("r_name"), F.lit(0.9), one))
        return part.union(supp).union(nation).union(region)

    def documents(self) -> DataFrame:
        return self.t("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"), F.sha2("c_name", 256).alias("content_hash"), F.lit(1).alias("version"))

    def text_units(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.t("orders").select(
            F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("id"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("document_id"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"),
            F.row_number().over(w).alias("start_char"),
        )

    def mentions(self) -> DataFrame:
        line = self.t("lineitem")
        unit = F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("text_unit_id")
        parts = line.select(unit, F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("entity_id"))
        return parts.union(line.select(unit, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))).distinct()

    def raw_relationships(self) -> DataFrame:
        """Repeated supplier-part edges, with the part's brand as key."""
        line = self.t("lineitem").select("l_suppkey", "l_partkey", "l_discount")
        part = self.t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("rel_key"))
        return line.join(part, "l_partkey").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("RELATED_TO").alias("rel_label"), "rel_key", (1 - F.col("l_discount")).alias("confidence"))

    def relationships(self) -> DataFrame:
        lines = self.raw_relationships().groupBy("src", "dst", "rel_label", "rel_key").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("weight"))
        edge = lambda t, p, a, q, b, key: self.t(t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"), F.lit("RELATED_TO").alias("rel_label"), F.lit(key).alias("rel_key"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("weight"))
        return lines.unionByName(edge("supplier", "S", "s_suppkey", "N", "s_nationkey", "IN_NATION")).unionByName(edge("nation", "N", "n_nationkey", "R", "n_regionkey", "IN_REGION"))

    def raw_claims(self) -> DataFrame:
        line = self.t("lineitem")
        part = self.t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("description"))
        status = F.when(F.col("l_returnflag") == "R", "TRUE").when(F.col("l_returnflag") == "A", "FALSE").otherwise("SUSPECTED")
        text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        return line.join(part, "l_partkey").select(text("S", "l_suppkey").alias("subject"), text("P", "l_partkey").alias("object"), F.col("l_linestatus").alias("claim_type"), status.alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_date"), F.lit(None).cast("string").alias("end_date"), "description", text("T", "l_orderkey").alias("source_text"))

    def claims(self) -> DataFrame:
        """Claims by id; the least status and date of an id stay."""
        from kgspark.functions.text import claim_id

        keyed = self.raw_claims().withColumn("claim_id", claim_id(*(F.col(c) for c in ("subject", "object", "claim_type", "description", "source_text"))))
        return keyed.groupBy("claim_id").agg(*(F.min(c).alias(c) for c in ("subject", "object", "claim_type", "status", "start_date", "description")), F.min("source_text").alias("text_unit_id"), F.count(F.lit(1)).alias("occurrence_count"))

    def membership(self) -> DataFrame:
        """Suppliers by nation, parts by key modulo 25."""
        s = self.t("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").cast("long").alias("community"))
        return s.union(self.t("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.col("p_partkey") % 25))

    def log(self) -> DataFrame:
        """Query log on the events: type as method, value scaled to milliseconds."""
        e = self.t("events")
        return e.select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("seq"),
            "ts",
            "user_id",
            F.col("event_type").alias("method"),
            F.when(F.col("event_id") % 10 == 0, "failed").otherwise("success").alias("status"),
            F.round(F.col("value") * 100, 0).alias("processing_time_ms"),
            ((F.col("event_id") % 11) / 10).alias("confidence_score"),
            (F.col("event_id") % 4).alias("n_steps"),
            (F.col("event_id") % 7).alias("n_triplets"),
            (F.col("event_id") % 5).alias("n_entities"),
            (F.col("event_id") % 6).alias("n_relations"),
            F.lit(3).alias("search_depth"),
        )


STAR_SQL = """WITH e AS (
  SELECT 'P' || p_partkey AS id, p_name AS name, p_type AS type, p_brand AS description, CAST(p_size / 50 AS DOUBLE) AS confidence, coalesce(n, 1) AS mention_count
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'SUPPLIER', 'nation ' || s_nationkey, 0.8::DOUBLE, coalesce(n, 1)
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'NATION', n_name, 0.9::DOUBLE, 1 FROM nation
  UNION ALL SELECT 'R' || r_regionkey, r_name, 'REGION', r_name, 0.9::DOUBLE, 1 FROM region
), d AS (
  SELECT 'C' || c_custkey AS id, c_name AS name, c_mktsegment AS status, sha256(c_name) AS content_hash, 1 AS version FROM customer
), tu AS (
  SELECT 'T' || o_orderkey AS id, 'C' || o_custkey AS document_id, o_orderpriority || ' ' || o_orderstatus AS text,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS start_char FROM orders
), m AS (
  SELECT DISTINCT 'T' || l_orderkey AS text_unit_id, 'P' || l_partkey AS entity_id FROM lineitem
  UNION SELECT DISTINCT 'T' || l_orderkey, 'S' || l_suppkey FROM lineitem
), raw_rel AS (
  SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, 'RELATED_TO' AS rel_label, p_brand AS rel_key, 1 - l_discount AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey
), rel AS (
  SELECT src, dst, rel_label, rel_key, max(confidence) AS confidence, count(*) AS weight FROM raw_rel GROUP BY ALL
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'RELATED_TO', 'IN_NATION', 1.0::DOUBLE, 1 FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'RELATED_TO', 'IN_REGION', 1.0::DOUBLE, 1 FROM nation
), raw_claim AS (
  SELECT 'S' || l_suppkey AS subject, 'P' || l_partkey AS object, l_linestatus AS claim_type,
    CASE l_returnflag WHEN 'R' THEN 'TRUE' WHEN 'A' THEN 'FALSE' ELSE 'SUSPECTED' END AS status,
    strftime(l_shipdate, '%Y-%m-%d') AS start_date, p_brand AS description, 'T' || l_orderkey AS source_text
  FROM lineitem JOIN part ON l_partkey = p_partkey
), claim AS (
  SELECT claim_id, min(subject) AS subject, min(object) AS object, min(claim_type) AS claim_type, min(status) AS status, min(start_date) AS start_date,
    min(description) AS description, min(source_text) AS text_unit_id, count(*) AS occurrence_count
  FROM (SELECT *, left(md5(concat_ws(':', subject, object, claim_type, description, source_text)), 16) AS claim_id FROM raw_claim) GROUP BY claim_id
), mem AS (
  SELECT 'S' || s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS community FROM supplier UNION ALL SELECT 'P' || p_partkey, p_partkey % 25 FROM part
), und AS (
  SELECT src, dst, rel_key, confidence FROM rel UNION ALL SELECT dst, src, rel_key, confidence FROM rel
), log AS (
  SELECT event_id AS id, event_id AS seq, ts, user_id, event_type AS method, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'success' END AS status,
    round(value * 100, 0) AS processing_time_ms, (event_id % 11) / 10 AS confidence_score, event_id % 4 AS n_steps, event_id % 7 AS n_triplets,
    event_id % 5 AS n_entities, event_id % 6 AS n_relations, 3 AS search_depth FROM events
)"""
