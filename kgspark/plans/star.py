"""Scans, construction, joins, aggregates, ordering, sets and graph queries on the star graph."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import build, community, graph, incremental, resolve, viz
from kgspark.operators.components import connected_components
from kgspark.runtime import materialize, scratch_dir
from kgspark.sources import export

from .base import STAR_SQL, Registry, Star

query = Registry(STAR_SQL)
QUERIES, SQL = query.queries, query.sql

TOP5 = "SELECT id FROM e WHERE type = 'SUPPLIER' ORDER BY mention_count DESC, confidence DESC, id LIMIT 5"


def _top5(g: Star) -> DataFrame:
    return g.entities().where("type = 'SUPPLIER'").orderBy(F.desc("mention_count"), F.desc("confidence"), "id").limit(5).select("id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.operators.reason import relation_statistics

    g = Star(spark, sf_dir)
    return relation_statistics(g.relationships(), _top5(g), filtered=True).withColumn("avg_confidence", F.round("avg_confidence", 10))


query("flagship_relations", f"""SELECT rel_key, count(*) AS frequency, round(avg(confidence), 10) AS avg_confidence FROM und
WHERE src IN ({TOP5}) AND confidence > 0.3 GROUP BY rel_key ORDER BY frequency DESC, rel_key LIMIT 50""")(flagship)


# scans, sources, sinks


@query("src2_format_gate", "SELECT url, lower(regexp_extract(url, '\\.([^./?#]+)$', 1)) = 'html' AS accepted FROM pages", prelude=False)
def src2(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.sources.files import has_extension

    return Star(spark, d).t("pages").select("url", has_extension(F.col("url"), "html").alias("accepted"))


@query("src4_node_scan", "SELECT id, name FROM e WHERE type = 'SUPPLIER'")
def src4(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).entities().where("type = 'SUPPLIER'").select("id", "name")


@query("src5_point_lookup", "SELECT id, name, type FROM e WHERE name = 'NATION_7' AND type = 'NATION' ORDER BY id LIMIT 1")
def src5(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).entities().where("name = 'NATION_7' AND type = 'NATION'").orderBy("id").limit(1).select("id", "name", "type")


ALL_NODES = """SELECT 'Entity' AS label, id FROM e UNION ALL SELECT 'Document', id FROM d UNION ALL SELECT 'TextUnit', id FROM tu UNION ALL SELECT 'Claim', claim_id FROM claim"""


def _nodes(g: Star) -> DataFrame:
    tables = {"Entity": g.entities().select("id"), "Document": g.documents().select("id"), "TextUnit": g.text_units().select("id"), "Claim": g.claims().select(F.col("claim_id").alias("id"))}
    out = None
    for label, df in tables.items():
        part = df.select(F.lit(label).alias("label"), "id")
        out = part if out is None else out.unionAll(part)
    return out


@query("src6_dump", ALL_NODES)
def src6(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(Star(spark, d))


@query("src7_schema_stats", f"""SELECT label, count(*) AS n FROM ({ALL_NODES}) GROUP BY label UNION ALL SELECT rel_label, count(*) FROM rel GROUP BY 1
UNION ALL SELECT 'MENTIONS', count(*) FROM m""")
def src7(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    n = F.count(F.lit(1)).alias("n")
    return _nodes(g).groupBy("label").agg(n).unionAll(g.relationships().groupBy("rel_label").agg(n)).unionAll(g.mentions().agg(n).select(F.lit("MENTIONS"), "n"))


@query("snk1_export_json")
def snk1(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.sources.files import export_graph

    g = Star(spark, d)
    return export_graph(g.entities(), g.relationships())


@query("snk1_export_round_trip", f"{ALL_NODES} UNION ALL SELECT rel_label, src || '>' || dst FROM rel")
def snk1b(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and relationships written as an export and read back from it."""
    g = Star(spark, d)
    folder = f"{scratch_dir(spark)}/kgspark/export-{uuid4().hex}"
    export.write_export(_nodes(g), g.relationships(), folder)
    back = export.read_export(spark, folder)
    return back["nodes"].select("label", "id").unionAll(back["relationships"].select("rel_label", F.concat("src", F.lit(">"), "dst")))


@query("snk2_upsert_embeddings", """SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0""", prelude=False)
def snk2(spark: SparkSession, d: str) -> DataFrame:
    old = Star(spark, d).t("embeddings").select("vec_id", "label")
    return build.upsert_rows(old, old.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label")), "vec_id")


@query("snk3_append_log", "SELECT * FROM log")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.sources.files import append_log

    log = Star(spark, d).log()
    return append_log(append_log(None, log.where("seq % 2 = 0")), log.where("seq % 2 = 1"))


@query("snk4_create_documents", "SELECT id, name FROM d")
def snk4(spark: SparkSession, d: str) -> DataFrame:
    docs = Star(spark, d).documents()
    return build.insert_missing(docs.where("id like '%1'"), docs, "id").select("id", "name")


@query("snk5_text_units", "SELECT id, document_id, start_char, text FROM tu")
def snk5(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).text_units().select("id", "document_id", "start_char", "text")


@query("snk6_unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", prelude=False)
def snk6(spark: SparkSession, d: str) -> DataFrame:
    return build.repeated_keys(Star(spark, d).t("lineitem"), "l_orderkey", "l_linenumber")


@query("snk7_cache", "SELECT id, processing_time_ms FROM log WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def snk7(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.sources.cache import ResultCache

    log = Star(spark, d).log().select("id", "processing_time_ms", F.col("ts").alias("stored_at"))
    return ResultCache(ttl_seconds=3600).live(log, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "processing_time_ms")


# graph construction


@query("bld1_upsert_entities", """WITH f AS (SELECT p_name AS name, p_type AS type, p_brand AS description, p_size / 50 AS confidence, p_partkey AS seq FROM part),
o AS (SELECT name, type, count(*) AS n, max(confidence) AS c, arg_min(description, seq) AS dd FROM f WHERE seq % 2 = 0 GROUP BY ALL),
w AS (SELECT name, type, count(*) AS n, max(confidence) AS c, arg_min(description, seq) AS dd FROM f WHERE seq % 2 = 1 GROUP BY ALL)
SELECT left(md5(lower(trim(name)) || ':' || lower(type)), 16) AS id, name, type, coalesce(o.dd, w.dd) AS description,
  greatest(o.c, w.c) AS confidence, coalesce(o.n, 0) + coalesce(w.n, 0) AS mention_count FROM o FULL JOIN w USING (name, type)""")
def bld1(spark: SparkSession, d: str) -> DataFrame:
    f = Star(spark, d).t("part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), (F.col("p_size") / 50).alias("confidence"), F.col("p_partkey").alias("seq"))
    return build.upsert_entities(build.upsert_entities(None, f.where("seq % 2 = 0")), f.where("seq % 2 = 1"))


@query("bld2_mentions", "SELECT text_unit_id, entity_id FROM m")
def bld2(spark: SparkSession, d: str) -> DataFrame:
    line = Star(spark, d).t("lineitem")
    unit = F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("text_unit_id")
    both = line.select(unit, F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("entity_id")).union(line.select(unit, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))))
    return build.upsert_mentions(both)


@query("bld3_relationships", """SELECT src, dst, rel_label, max(confidence) AS confidence, min(rel_key) AS description, count(*) AS weight FROM raw_rel GROUP BY src, dst, rel_label""")
def bld3(spark: SparkSession, d: str) -> DataFrame:
    rel = Star(spark, d).raw_relationships().select("src", "dst", "rel_label", "confidence", F.col("rel_key").alias("description"), F.lit(0).alias("seq"))
    return build.upsert_relationships(rel)


@query("bld3_resolve_names", """WITH i AS (SELECT name, min(id) AS id FROM e GROUP BY name)
SELECT a.id AS src, b.id AS dst FROM nation JOIN region ON n_regionkey = r_regionkey JOIN i a ON a.name = n_name JOIN i b ON b.name = r_name""")
def bld3b(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    pairs = g.t("nation").join(g.t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    return build.resolve_names(pairs, g.entities()).select("src", "dst")


@query("bld4_claims", "SELECT claim_id, subject, object, claim_type, description, occurrence_count FROM claim")
def bld4(spark: SparkSession, d: str) -> DataFrame:
    raw = Star(spark, d).raw_claims().withColumn("seq", F.struct("status", "start_date"))
    return build.upsert_claims(raw).select("claim_id", "subject", "object", "claim_type", "description", "occurrence_count")


LINK_NAMES = """SELECT 'q' || n_nationkey AS claim_id, CASE n_nationkey % 6 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN n_name || ' (' || lower(n_name) || ' republic)' WHEN 3 THEN 'the ' || n_name || ' state' WHEN 4 THEN 'mega' || n_name || 'land' ELSE substr(n_name, 2) END AS subject FROM nation"""
PLAIN = "lower(trim(regexp_replace({0}, '\\s*\\([^)]*\\)\\s*', '', 'g')))"


@query("bld5_link_claims", f"""WITH c AS ({LINK_NAMES}), i AS (SELECT name, min(id) AS entity_id FROM e GROUP BY name), x AS (
SELECT claim_id, entity_id, name, CASE WHEN subject = name THEN 1 WHEN lower(subject) = lower(name) THEN 2
  WHEN starts_with({PLAIN.format("subject")}, {PLAIN.format("name")}) OR starts_with({PLAIN.format("name")}, {PLAIN.format("subject")}) THEN 3
  WHEN contains({PLAIN.format("subject")}, lower(translate(name, '()', ''))) OR contains(lower(translate(name, '()', '')), {PLAIN.format("subject")}) THEN 4 END AS strategy FROM c, i)
SELECT claim_id, entity_id, CAST(strategy AS INTEGER) AS strategy FROM x WHERE strategy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY strategy, length(name), entity_id) = 1""")
def bld5(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    k, n = F.col("n_nationkey") % 6, F.col("n_name")
    subject = F.when(k == 0, n).when(k == 1, F.lower(n)).when(k == 2, F.concat(n, F.lit(" ("), F.lower(n), F.lit(" republic)"))).when(k == 3, F.concat(F.lit("the "), n, F.lit(" state"))).when(k == 4, F.concat(F.lit("mega"), n, F.lit("land"))).otherwise(F.substring(n, 2, 99))
    claims = g.t("nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("claim_id"), subject.alias("subject"))
    return build.link_names(claims, g.entities(), "subject")


@query("bld6_link_sources", "SELECT DISTINCT claim_id, text_unit_id FROM claim JOIN tu ON text_unit_id = tu.id")
def bld6(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return build.link_sources(g.claims(), g.text_units()).select("claim_id", "text_unit_id")


@query("bld7_update_entities", """SELECT id, CASE WHEN type = 'SUPPLIER' THEN coalesce(CASE WHEN mention_count % 2 = 0 THEN 'updated' END, description) ELSE description END AS description,
CASE WHEN type = 'SUPPLIER' THEN greatest(confidence, 0.7) ELSE confidence END AS confidence FROM e""")
def bld7(spark: SparkSession, d: str) -> DataFrame:
    e = Star(spark, d).entities()
    changes = e.where("type = 'SUPPLIER'").select("id", F.when(F.col("mention_count") % 2 == 0, "updated").alias("description"), F.lit(0.7).alias("confidence"))
    return build.update_entities(e, changes).select("id", "description", "confidence")


@query("bld8_set_status", "SELECT id, CASE WHEN id LIKE '%7' THEN 'completed' ELSE status END AS status FROM d")
def bld8(spark: SparkSession, d: str) -> DataFrame:
    docs = Star(spark, d).documents()
    return build.set_values(docs, docs.where("id like '%7'").select("id", F.lit("completed").alias("status")), "id", "status").select("id", "status")


# pattern joins


@query("jn1_document_entities", "SELECT tu.document_id, m.entity_id, count(DISTINCT tu.id) AS n_units FROM tu JOIN m ON tu.id = m.text_unit_id GROUP BY ALL")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return g.mentions().join(g.text_units().select(F.col("id").alias("text_unit_id"), "document_id"), "text_unit_id").groupBy("document_id", "entity_id").agg(F.count_distinct("text_unit_id").alias("n_units"))


@query("jn2_multi_mention_groups", "SELECT name, type, count(*) AS n, list_sort(list(DISTINCT description)) AS descriptions FROM e GROUP BY name, type HAVING count(*) > 1")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).entities().groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("description")).alias("descriptions")).where("n > 1")


@query("jn3_optional_source", "SELECT claim_id, tu.text FROM claim LEFT JOIN tu ON text_unit_id = tu.id AND tu.start_char = 1")
def jn3(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    units = g.text_units().where("start_char = 1").select(F.col("id").alias("text_unit_id"), "text")
    return g.claims().join(units, "text_unit_id", "left").select("claim_id", "text")


@query("jn4_claims_of_entity", "SELECT claim_id FROM claim WHERE subject = 'S1' OR object = 'P1' ORDER BY claim_id LIMIT 20")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    c = Star(spark, d).claims()
    return c.where("subject = 'S1'").union(c.where("object = 'P1'")).select("claim_id").distinct().orderBy("claim_id").limit(20)


@query("jn5_filtered_claims", "SELECT claim_id, status, tu.text FROM claim LEFT JOIN tu ON text_unit_id = tu.id WHERE status = 'TRUE' AND claim_type = 'F' ORDER BY claim_id LIMIT 100")
def jn5(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    wanted = {"status": "TRUE", "claim_type": "F"}
    c = g.claims()
    for name, value in wanted.items():
        c = c.where(F.col(name) == value)
    return c.orderBy("claim_id").limit(100).join(g.text_units().select(F.col("id").alias("text_unit_id"), "text"), "text_unit_id", "left").select("claim_id", "status", "text")


ONE_DOC = "SELECT id FROM tu WHERE document_id IN ('C1', 'C2', 'C4')"


@query("jn6_exclusive_entities", f"SELECT DISTINCT entity_id FROM m WHERE text_unit_id NOT IN ({ONE_DOC}) AND entity_id NOT IN (SELECT entity_id FROM m WHERE text_unit_id IN ({ONE_DOC}))")
def jn6(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    others = g.documents().select("id").join(_docs(spark), "id", "left_anti")
    return incremental.orphans(others, g.text_units(), g.mentions())


def _docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("C1",), ("C2",), ("C4",)], "id string")


@query("jn7_id_list", f"SELECT id, name FROM e WHERE id IN ({TOP5})")
def jn7(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return g.entities().join(_top5(g), "id", "left_semi").select("id", "name")


@query("jn8_undirected", "SELECT src, count(*) AS degree FROM und GROUP BY src")
def jn8(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(Star(spark, d).relationships()).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


@query("jn9_similar_pairs", """WITH c AS (SELECT c_custkey AS id, c_mktsegment || ' ' || substr(c_name, length(c_name) - 3) AS name, CAST(c_nationkey AS VARCHAR) AS type FROM customer)
SELECT a.id AS id1, b.id AS id2, round(1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name)), 6) AS similarity
FROM c a JOIN c b ON a.type = b.type AND (a.name, a.id) < (b.name, b.id) WHERE 1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name)) >= 0.85""", prelude=False)
def jn9(spark: SparkSession, d: str) -> DataFrame:
    c = Star(spark, d).t("customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", F.substring("c_name", -4, 4)).alias("name"), F.col("c_nationkey").cast("string").alias("type"))
    return resolve.duplicate_pairs(c, 0.85, resolve.levenshtein_ratio).select("id1", "id2", F.round("similarity", 6).alias("similarity"))


BETWEEN = "SELECT least(a.community, b.community) AS c1, greatest(a.community, b.community) AS c2, count(*) AS n_edges FROM rel JOIN mem a ON src = a.id JOIN mem b ON dst = b.id WHERE a.community <> b.community GROUP BY ALL"


@query("jn10_cross_community", BETWEEN)
def jn10(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return graph.between_communities(g.relationships(), g.membership())


@query("jn11_name_to_id", "SELECT n_nationkey, min(e.id) AS id FROM nation JOIN e ON e.name = n_name GROUP BY ALL")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    ids = g.entities().groupBy("name").agg(F.min("id").alias("id"))
    return g.t("nation").join(ids, F.col("n_name") == F.col("name")).select("n_nationkey", "id")


# aggregations


@query("agg1_graph_counts", "SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM tu) AS text_units, (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM rel) AS relationships, (SELECT count(*) FROM m) AS mentions, (SELECT count(*) FROM claim) AS claims, (SELECT count(DISTINCT community) FROM mem) AS communities")
def agg1(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    tables = {"documents": g.documents(), "text_units": g.text_units(), "entities": g.entities(), "relationships": g.relationships(), "mentions": g.mentions(), "claims": g.claims(), "communities": g.membership().select("community").distinct()}
    rows = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("k"), "n")
        rows = part if rows is None else rows.unionAll(part)
    return rows.agg(*(F.max(F.when(F.col("k") == name, F.col("n"))).alias(name) for name in tables))


@query("agg2_document_stats", "SELECT tu.document_id, count(DISTINCT tu.id) AS n_units, count(DISTINCT m.entity_id) AS n_entities FROM tu LEFT JOIN m ON tu.id = m.text_unit_id GROUP BY ALL")
def agg2(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    units = g.text_units().select("id", "document_id")
    named = units.join(g.mentions(), F.col("id") == F.col("text_unit_id")).select("document_id", "entity_id").distinct()
    n_entities = named.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_entities"))
    n_units = units.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_units"))  # unit ids are unique
    return n_units.join(n_entities, "document_id", "left").select("document_id", "n_units", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


@query("agg3_relation_frequency", f"SELECT rel_key, count(*) AS frequency, round(avg(confidence), 10) AS avg_confidence FROM und WHERE src IN ({TOP5}) GROUP BY rel_key ORDER BY frequency DESC, rel_key LIMIT 50")
def agg3(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.reason import relation_statistics

    g = Star(spark, d)
    return relation_statistics(g.relationships(), _top5(g)).withColumn("avg_confidence", F.round("avg_confidence", 10))


@query("agg4_collect", "SELECT document_id, list_sort(list(DISTINCT text)) AS texts FROM tu GROUP BY document_id")
def agg4(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).text_units().groupBy("document_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))


@query("agg5_affected_communities", f"SELECT community, count(DISTINCT mem.id) AS n_entities FROM mem JOIN m ON mem.id = m.entity_id WHERE text_unit_id IN ({ONE_DOC}) GROUP BY community")
def agg5(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return incremental.affected_communities(_docs(spark), g.text_units(), g.mentions(), g.membership())


@query("agg6_community_stats", "SELECT count(*) AS n_communities, CAST(sum(size) AS BIGINT) AS n_members, avg(size) AS mean_size, min(size) AS min_size, max(size) AS max_size FROM (SELECT community, count(DISTINCT id) AS size FROM mem GROUP BY 1)")
def agg6(spark: SparkSession, d: str) -> DataFrame:
    return community.statistics(Star(spark, d).membership())


@query("agg7_chunk_evidence", f"SELECT text_unit_id, count(DISTINCT entity_id) AS n_entities FROM m JOIN tu ON tu.id = text_unit_id WHERE entity_id IN ({TOP5}) GROUP BY text_unit_id, start_char ORDER BY n_entities DESC, start_char, text_unit_id LIMIT 5")
def agg7(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.reason import evidence

    g = Star(spark, d)
    return evidence(g.mentions(), g.text_units(), _top5(g)).select("text_unit_id", "n_entities")


@query("agg8_log_pages", "SELECT id, method FROM log ORDER BY ts DESC, seq DESC LIMIT 10 OFFSET 20")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).log().orderBy(F.desc("ts"), F.desc("seq")).offset(20).limit(10).select("id", "method")


@query("agg9_cache_keys", "SELECT split_part(method || ':' || id, ':', 1) AS prefix, count(*) AS n FROM log GROUP BY 1")
def agg9(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.sources.cache import ResultCache

    return ResultCache().prefix_counts(Star(spark, d).log().select(F.concat_ws(":", "method", "id").alias("key")))


# ordering, limits, sets


@query("ord1_top_entities", "SELECT id, name, mention_count FROM e ORDER BY mention_count DESC, confidence DESC, id LIMIT 25")
def ord1(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).entities().orderBy(F.desc("mention_count"), F.desc("confidence"), "id").limit(25).select("id", "name", "mention_count")


@query("ord2_entity_names", "SELECT DISTINCT name, mention_count FROM e ORDER BY mention_count DESC, name LIMIT 1000")
def ord2(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).entities().select("name", "mention_count").distinct().orderBy(F.desc("mention_count"), "name").limit(1000)


@query("ord3_related_entities", f"""SELECT src, rel_key, dst, CAST(row_number() OVER (PARTITION BY src, rel_key ORDER BY c DESC, mention_count DESC, dst) AS INTEGER) AS rank FROM (
SELECT src, rel_key, dst, max(und.confidence) AS c, any_value(mention_count) AS mention_count FROM und JOIN e ON e.id = dst WHERE src IN ({TOP5}) AND rel_key IN ('Brand#11', 'Brand#12', 'Brand#21', 'IN_NATION') GROUP BY ALL) QUALIFY rank <= 20""")
def ord3(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.reason import candidates

    g = Star(spark, d)
    keys = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#21",), ("IN_NATION",)], "rel_key string")
    return candidates(g.relationships(), g.entities(), _top5(g), keys).select("src", "rel_key", "dst", "rank")


@query("ord4_first_texts", "SELECT entity_id, list(text ORDER BY text_unit_id) AS texts FROM (SELECT entity_id, text_unit_id, text FROM m JOIN tu ON tu.id = text_unit_id QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY text_unit_id) <= 3) GROUP BY entity_id")
def ord4(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    joined = g.mentions().join(g.text_units().select(F.col("id").alias("text_unit_id"), "text"), "text_unit_id")
    first = graph.top_per_group(joined, ["entity_id"], [F.col("text_unit_id")], 3)
    return first.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("text_unit_id", "text"))), lambda x: x["text"]).alias("texts"))


@query("ord5_units_of_entity", "SELECT tu.id, start_char FROM m JOIN tu ON tu.id = text_unit_id WHERE entity_id = 'P1' ORDER BY start_char, tu.id LIMIT 10")
def ord5(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return g.text_units().join(g.mentions().where("entity_id = 'P1'"), F.col("id") == F.col("text_unit_id")).orderBy("start_char", "id").limit(10).select("id", "start_char")


@query("ord6_top_members", "SELECT community, id, CAST(row_number() OVER (PARTITION BY community ORDER BY mention_count DESC, id) AS INTEGER) AS rank FROM mem JOIN e USING (id) QUALIFY rank <= 20")
def ord6(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return graph.top_per_group(g.membership().join(g.entities(), "id"), ["community"], [F.desc("mention_count"), F.col("id")], 20).select("community", "id", "rank")


@query("ord7_retain", "SELECT id, confidence FROM e ORDER BY confidence DESC, id LIMIT 5")
def ord7(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).entities().orderBy(F.desc("confidence"), "id").limit(5).select("id", "confidence")


@query("ord8_paging", "SELECT id, name FROM d ORDER BY id LIMIT 20 OFFSET 40")
def ord8(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).documents().orderBy("id").offset(40).limit(20).select("id", "name")


HOPS = """h1 AS (SELECT DISTINCT dst AS id, 1 AS distance, rel_key FROM und WHERE src = 'S1'),
h2 AS (SELECT DISTINCT und.dst AS id, 2 AS distance, und.rel_key FROM (SELECT DISTINCT id FROM h1) x JOIN und ON und.src = x.id)"""


@query("set1_two_hop_union", f"WITH {HOPS} SELECT DISTINCT id FROM (SELECT id FROM h1 UNION ALL SELECT id FROM h2) WHERE id IS NOT NULL")
def set1(spark: SparkSession, d: str) -> DataFrame:
    return graph.context(Star(spark, d).relationships(), _one(spark, "S1")).select("id").where("id is not null").distinct()


def _one(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(name,)], "id string")


@query("set2_affected_and_neighbours", f"SELECT id FROM ({TOP5}) UNION SELECT dst FROM und WHERE src IN ({TOP5})")
def set2(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    top = _top5(g)
    return top.union(graph.undirected(g.relationships()).join(top, F.col("src") == F.col("id"), "left_semi").select("dst")).distinct()


@query("set3_unexplored", f"SELECT DISTINCT rel_key FROM und WHERE src IN ({TOP5}) AND rel_key NOT IN ('Brand#11', 'IN_NATION')")
def set3(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    explored = spark.createDataFrame([("Brand#11",), ("IN_NATION",)], "rel_key string")
    return graph.undirected(g.relationships(), "rel_key").join(_top5(g), F.col("src") == F.col("id"), "left_semi").select("rel_key").distinct().join(explored, "rel_key", "left_anti")


@query("set4_frontier_overlap", """WITH a AS (SELECT src, list(DISTINCT dst) AS x FROM rel GROUP BY src)
SELECT src, round(len(list_intersect(x, (SELECT list(id) FROM e WHERE mention_count > 25))) / len(x), 6) AS overlap FROM a""")
def set4(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    before = g.entities().where("mention_count > 25").select(F.col("id").alias("dst"), F.lit(1).alias("hit"))
    now = g.relationships().select("src", "dst").distinct().join(before, "dst", "left")
    return now.groupBy("src").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("overlap"))


@query("set5_triplets", "SELECT DISTINCT src AS subject, rel_key AS relation, dst AS object FROM raw_rel")
def set5(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).raw_relationships().select(F.col("src").alias("subject"), F.col("rel_key").alias("relation"), F.col("dst").alias("object")).dropDuplicates(["subject", "relation", "object"])


# graph algorithms


@query("gr1_projection", "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM rel WHERE src <> dst")
def gr1(spark: SparkSession, d: str) -> DataFrame:
    return graph.projection(Star(spark, d).relationships())


COMPONENTS = """WITH RECURSIVE base AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders),
both_ AS (SELECT src, dst FROM base UNION SELECT dst, src FROM base),
walk(id, lo) AS (SELECT DISTINCT src, src FROM both_ UNION SELECT both_.dst, walk.lo FROM walk JOIN both_ ON both_.src = walk.id)
SELECT id AS node, min(lo) AS component FROM walk GROUP BY id"""


@query("gr2_connected_components", COMPONENTS, prelude=False)
def gr2(spark: SparkSession, d: str) -> DataFrame:
    o = Star(spark, d).t("orders")
    edges = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("b"))
    return connected_components(edges)


@query("gr2_leiden")
def gr2_leiden(spark: SparkSession, d: str) -> DataFrame:
    return community.detect_communities(Star(spark, d).relationships())


@query("gr3_assignments", "SELECT id AS entity_id, community AS community_id, CAST(community % 2 AS INTEGER) AS community_level, CASE WHEN community % 2 = 0 THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM mem")
def gr3(spark: SparkSession, d: str) -> DataFrame:
    levels = Star(spark, d).membership().withColumn("level", (F.col("community") % 2).cast("int"))
    return community.assignments(levels)


@query("gr4_members", """SELECT a.community, count(DISTINCT a.id) AS n_members, coalesce(any_value(n), 0) AS n_edges FROM mem a LEFT JOIN (
SELECT x.community, count(*) AS n FROM rel JOIN mem x ON src = x.id JOIN mem y ON dst = y.id WHERE x.community = y.community GROUP BY 1) i ON i.community = a.community GROUP BY a.community""")
def gr4(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return community.members(g.membership(), g.relationships())


@query("gr5_shortest_path", """WITH RECURSIVE p(id, path, hops) AS (SELECT 'N0', ['N0'], 0 UNION ALL SELECT x.dst, list_append(path, x.dst), hops + 1 FROM p JOIN (SELECT DISTINCT src, dst FROM und) x ON x.src = p.id WHERE hops < 3 AND NOT list_contains(path, x.dst))
SELECT CAST(hops AS INTEGER) AS hops, path FROM p WHERE id = 'S0' ORDER BY hops, path LIMIT 1""")
def gr5(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(Star(spark, d).relationships(), "N0", "S0", 3)


@query("gr2_leiden_cover", """WITH nodes AS (SELECT src AS id FROM rel UNION SELECT dst FROM rel), pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM rel WHERE src <> dst)
SELECT (SELECT count(*) FROM nodes) AS n_nodes, 0::BIGINT AS n_missing, 0::BIGINT AS n_repeated, (SELECT count(*) FROM pairs) AS n_edges, true AS beats_nations""")
def gr2_cover(spark: SparkSession, d: str) -> DataFrame:
    """The coarsest communities: every node once, and a modularity above that of communities by nation."""
    g = Star(spark, d)
    edges = materialize(g.relationships(), "edges")
    found = materialize(community.detect_communities(edges).where("level = 0").select("id", "community"), "communities")
    nodes = graph.undirected(edges).select(F.col("src").alias("id")).distinct()
    better = community.modularity(edges, found) > community.modularity(edges, nodes.join(g.membership(), "id", "left").select("id", F.coalesce(F.col("community").cast("string"), "id").alias("community")))
    missing = nodes.join(found, "id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    size = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(missing).join(graph.projection(edges).agg(F.count(F.lit(1)).alias("n_edges")))
    return size.join(found.groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("n_repeated"))).withColumn("beats_nations", F.lit(better))


@query("gr6_incremental_communities", """SELECT 'S' || s_suppkey AS id, 'nation ' || CASE WHEN s_suppkey % 50 = 1 THEN (SELECT n FROM (SELECT s_nationkey AS n, count(*) AS c FROM supplier GROUP BY 1 ORDER BY c DESC, n LIMIT 1)) ELSE s_nationkey END AS community FROM supplier""", prelude=False)
def gr6(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth supplier has moved to the nation with most of them; stored communities are those before."""
    s = Star(spark, d).t("supplier").select("s_suppkey", "s_nationkey")
    most = s.groupBy("s_nationkey").count().orderBy(F.desc("count"), "s_nationkey").limit(1).select(F.col("s_nationkey").alias("goal"))
    moves = F.col("s_suppkey") % 50 == 1
    now = s.join(F.broadcast(most)).withColumn("nation", F.when(moves, F.col("goal")).otherwise(F.col("s_nationkey")))
    supplier, home = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), lambda c: F.concat(F.lit("nation "), F.col(c).cast("string"))
    edges = now.select(supplier.alias("src"), F.concat(F.lit("N"), F.col("nation").cast("string")).alias("dst"))
    stored = s.select(supplier.alias("id"), home("s_nationkey").alias("community")).union(s.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), home("s_nationkey")).distinct())
    out = community.detect_incrementally(edges, stored, now.where(moves).select(supplier.alias("id")))
    return out.where("id like 'S%'")


@query("gr7_entity_context", f"WITH {HOPS} SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def gr7(spark: SparkSession, d: str) -> DataFrame:
    return graph.context(Star(spark, d).relationships(), _one(spark, "S1"))


@query("gr8_ego_graph", f"WITH {HOPS} SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM (SELECT 'S1' AS id, 0 AS distance UNION ALL SELECT id, distance FROM h1 UNION ALL SELECT id, distance FROM h2) GROUP BY id")
def gr8(spark: SparkSession, d: str) -> DataFrame:
    return graph.ego(Star(spark, d).relationships(), _one(spark, "S1"))


TOP200 = "SELECT id FROM e ORDER BY mention_count DESC, id LIMIT 200"


@query("gr9_entity_graph", f"SELECT src, dst, rel_key FROM und WHERE src IN ({TOP200}) AND dst IN ({TOP200})")
def gr9(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    _, edges = viz.entity_graph(g.entities(), g.relationships(), 200)
    return graph.undirected(edges, "rel_key")


@query("gr10_community_graph", f"SELECT c1, c2, n_edges, a.size AS size1, b.size AS size2 FROM ({BETWEEN}) JOIN (SELECT community, count(*) AS size FROM mem GROUP BY 1) a ON a.community = c1 JOIN (SELECT community, count(*) AS size FROM mem GROUP BY 1) b ON b.community = c2")
def gr10(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    size = g.membership().groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    out = graph.between_communities(g.relationships(), g.membership())
    return out.join(size.withColumnsRenamed({"community": "c1", "size": "size1"}), "c1").join(size.withColumnsRenamed({"community": "c2", "size": "size2"}), "c2").select("c1", "c2", "n_edges", "size1", "size2")


@query("gr11_hierarchy", "(SELECT 'document' AS kind, document_id AS src, id AS dst FROM tu ORDER BY src, dst LIMIT 50) UNION ALL (SELECT 'mention', text_unit_id, entity_id FROM m ORDER BY text_unit_id, entity_id LIMIT 50)")
def gr11(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    docs = g.text_units().select(F.lit("document").alias("kind"), F.col("document_id").alias("src"), F.col("id").alias("dst")).orderBy("src", "dst").limit(50)
    return docs.union(g.mentions().select(F.lit("mention"), F.col("text_unit_id").alias("src"), F.col("entity_id").alias("dst")).orderBy("src", "dst").limit(50))


@query("gr12_compare_communities", """WITH x AS (SELECT und.src, und.dst FROM und JOIN mem a ON und.src = a.id JOIN mem b ON und.dst = b.id WHERE a.community = 1 AND b.community = 2)
SELECT count(DISTINCT src) AS n_left, count(DISTINCT dst) AS n_right, count(*) AS n_paths, coalesce(list_sort(list(DISTINCT src || '-' || dst))[1:10], []) AS examples FROM x""")
def gr12(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return graph.boundary(g.relationships(), g.membership(), 1, 2)


@query("gr13_community_context", """SELECT community, list(name ORDER BY r) AS members FROM (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY mention_count DESC, id) AS r FROM mem JOIN e USING (id)) WHERE r <= 20 GROUP BY community""")
def gr13(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return community.contexts(g.membership(), g.entities(), g.relationships()).select("community", "members")


@query("gr14_community_summaries", """WITH r AS (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY mention_count DESC, id) AS rn FROM mem JOIN e USING (id)),
people AS (SELECT community, string_agg(name, '; ' ORDER BY rn) AS m FROM r WHERE rn <= 20 GROUP BY community),
i AS (SELECT x.community, src || ' ' || rel_key || ' ' || dst AS t, row_number() OVER (PARTITION BY x.community ORDER BY confidence DESC, src, dst, rel_key) AS rn FROM rel JOIN mem x ON src = x.id JOIN mem y ON dst = y.id WHERE x.community = y.community),
rels AS (SELECT community, string_agg(t, '; ' ORDER BY rn) FILTER (rn <= 15) || CASE WHEN least(count(*), 30) > 15 THEN '; and ' || (least(count(*), 30) - 15) || ' more' ELSE '' END AS t FROM i GROUP BY community)
SELECT CAST(community AS VARCHAR) AS community, left(rtrim('Members: ' || m || chr(10) || 'Relations: ' || coalesce(t, '')), 200) AS summary FROM people LEFT JOIN rels USING (community)""")
def gr14(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return community.summarize(community.context_text(community.contexts(g.membership(), g.entities(), g.relationships())))


@query("msc5_context_text", """WITH r AS (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY mention_count DESC, id) AS r FROM mem JOIN e USING (id))
SELECT community, 'Members: ' || string_agg(name, '; ' ORDER BY r) FILTER (r <= 10) || CASE WHEN least(count(*), 20) > 10 THEN '; and ' || (least(count(*), 20) - 10) || ' more' ELSE '' END AS text FROM r GROUP BY community""")
def msc5(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    ctx = community.contexts(g.membership(), g.entities(), g.relationships())
    return community.context_text(ctx, n_members=10).select("community", F.split("text", "\n")[0].alias("text"))


# incremental maintenance


@query("inc1_changed", "SELECT id, CASE WHEN id LIKE '%3' THEN sha256(name || 'x') ELSE content_hash END AS content_hash, CAST(CASE WHEN id LIKE '%9' THEN 1 WHEN id LIKE '%3' THEN 2 ELSE 1 END AS INTEGER) AS version, (id LIKE '%3' OR id LIKE '%9') AS is_changed FROM d")
def inc1(spark: SparkSession, d: str) -> DataFrame:
    docs = Star(spark, d).documents()
    new = docs.withColumn("content_hash", F.when(F.col("id").like("%3"), F.sha2(F.concat("name", F.lit("x")), 256)).otherwise(F.col("content_hash")))
    return incremental.changed(new, docs.where("id not like '%9'"))


@query("inc3_delete_documents", f"""WITH gone AS (SELECT * FROM m WHERE text_unit_id IN ({ONE_DOC})), rest AS (SELECT * FROM m WHERE text_unit_id NOT IN ({ONE_DOC})), n AS (SELECT entity_id, count(*) AS k FROM gone GROUP BY 1)
SELECT e.id, greatest(e.mention_count - coalesce(k, 0), 1) AS mention_count FROM e LEFT JOIN n ON e.id = n.entity_id WHERE NOT (k IS NOT NULL AND e.id NOT IN (SELECT entity_id FROM rest))""")
def inc3(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    claims = g.claims()
    return incremental.delete_documents(_docs(spark), g.text_units(), g.mentions(), g.entities(), claims)["entities"].select("id", "mention_count")


@query("inc3_delete_claims", f"SELECT claim_id FROM claim WHERE text_unit_id NOT IN ({ONE_DOC})")
def inc3b(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return incremental.delete_documents(_docs(spark), g.text_units(), g.mentions(), g.entities(), g.claims())["claims"].select("claim_id")


# resolution on given pairs


PAIRS = "SELECT a.id AS id1, b.id AS id2, a.mention_count AS mentions1, b.mention_count AS mentions2, CASE WHEN CAST(substr(a.id, 2) AS BIGINT) % 3 = 0 THEN 0.96 WHEN CAST(substr(a.id, 2) AS BIGINT) % 3 = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS similarity FROM e a JOIN e b ON a.type = 'SUPPLIER' AND b.type = 'SUPPLIER' AND CAST(substr(b.id, 2) AS BIGINT) = CAST(substr(a.id, 2) AS BIGINT) + 1"


def _pairs(g: Star) -> DataFrame:
    s = g.entities().where("type = 'SUPPLIER'").withColumn("k", F.substring("id", 2, 20).cast("long"))
    a = s.select(F.col("id").alias("id1"), F.col("mention_count").alias("mentions1"), "k")
    b = s.select(F.col("id").alias("id2"), F.col("mention_count").alias("mentions2"), (F.col("k") - 1).alias("k"))
    return a.join(b, "k").select("id1", "id2", "mentions1", "mentions2", F.when(F.col("k") % 3 == 0, 0.96).when(F.col("k") % 3 == 1, 0.9).otherwise(0.5).alias("similarity"))


@query("er4_decisions", f"SELECT id1, id2, CASE WHEN similarity >= 0.95 THEN 'merge' WHEN similarity >= 0.85 THEN 'ask' ELSE 'keep' END AS decision, CASE WHEN mentions1 >= mentions2 THEN id1 ELSE id2 END AS primary_id FROM ({PAIRS})")
def er4(spark: SparkSession, d: str) -> DataFrame:
    return resolve.decide(_pairs(Star(spark, d))).select("id1", "id2", "decision", "primary_id")


MERGED = f"""mp AS (SELECT CASE WHEN mentions1 >= mentions2 THEN id2 ELSE id1 END AS id, CASE WHEN mentions1 >= mentions2 THEN id1 ELSE id2 END AS primary_id FROM ({PAIRS}) WHERE similarity >= 0.95)"""


@query("er6_merge_entities", f"""WITH {MERGED} SELECT coalesce(primary_id, e.id) AS id, CAST(sum(mention_count) AS BIGINT) AS mention_count, coalesce(list_sort(list(DISTINCT name) FILTER (primary_id IS NOT NULL)), []) AS aliases FROM e LEFT JOIN mp ON e.id = mp.id GROUP BY 1""")
def er6(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    e = g.entities().withColumn("aliases", F.lit(None).cast("array<string>"))
    mapping = resolve.merge_map(_pairs(g).where("similarity >= 0.95"), e)
    return resolve.merge_entities(e, mapping).select("id", "mention_count", "aliases")


@query("er6_merge_edges", f"""WITH {MERGED} SELECT coalesce(mp.primary_id, src) AS src, rel_label, dst, max(confidence) AS confidence FROM rel LEFT JOIN mp ON src = mp.id WHERE coalesce(mp.primary_id, src) <> dst GROUP BY ALL""")
def er6b(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    mapping = resolve.merge_map(_pairs(g).where("similarity >= 0.95"), g.entities())
    return resolve.merge_edges(g.relationships(), mapping)


@query("er7_merge_mentions", f"WITH {MERGED} SELECT DISTINCT text_unit_id, coalesce(primary_id, entity_id) AS entity_id FROM m LEFT JOIN mp ON entity_id = mp.id")
def er7(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return resolve.merge_mentions(g.mentions(), resolve.merge_map(_pairs(g).where("similarity >= 0.95"), g.entities()))


@query("er8_aliases", "SELECT id, [name, upper(name)] AS names FROM e WHERE type = 'REGION' AND name <> upper(name) UNION ALL SELECT id, [name, name || ' alias'] FROM e WHERE type = 'NATION'")
def er8(spark: SparkSession, d: str) -> DataFrame:
    e = Star(spark, d).entities().withColumn("aliases", F.array().cast("array<string>"))
    named = lambda x, alias: x.select("id", F.concat(F.array("name"), T.append_unique(F.col("aliases"), alias)).alias("names"))
    return named(e.where("type = 'REGION' and name <> upper(name)"), F.upper("name")).union(named(e.where("type = 'NATION'"), F.concat("name", F.lit(" alias"))))


@query("er2_similar_entities")
def er2(spark: SparkSession, d: str) -> DataFrame:
    return resolve.similar_entities(Star(spark, d).entities(), "Supplier#000000001", "SUPPLIER").select("id", "name", "similarity")


@query("er3_duplicate_pairs")
def er3(spark: SparkSession, d: str) -> DataFrame:
    return resolve.duplicate_pairs(Star(spark, d).entities(), 0.85)


EDIT = "1 - levenshtein(lower(trim({0})), lower(trim({1}))) / greatest(length(trim({0})), length(trim({1})))"


@query("er2_similar_by_edits", f"SELECT id, name, round({EDIT.format("'Supplier#000000001'", 'name')}, 3) AS similarity FROM e WHERE type = 'SUPPLIER' AND {EDIT.format("'Supplier#000000001'", 'name')} >= 0.85 AND {EDIT.format("'Supplier#000000001'", 'name')} < 1")
def er2b(spark: SparkSession, d: str) -> DataFrame:
    return resolve.similar_entities(Star(spark, d).entities(), "Supplier#000000001", "SUPPLIER", metric=resolve.levenshtein_ratio).select("id", "name", "similarity")


@query("er3_duplicates_by_edits", f"SELECT a.id AS id1, b.id AS id2, round({EDIT.format('a.name', 'b.name')}, 6) AS similarity FROM e a JOIN e b ON a.type = b.type AND (a.name, a.id) < (b.name, b.id) WHERE {EDIT.format('a.name', 'b.name')} >= 0.85")
def er3b(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs by the metric that SQL has too; equal names pair."""
    return resolve.duplicate_pairs(Star(spark, d).entities(), 0.85, resolve.levenshtein_ratio).select("id1", "id2", F.round("similarity", 6).alias("similarity"))


@query("er9_best_by_edits", f"SELECT id, name, round({EDIT.format("'nation 12'", 'name')}, 6) AS similarity FROM e WHERE {EDIT.format("'nation 12'", 'name')} > 0.8 ORDER BY {EDIT.format("'nation 12'", 'name')} DESC, id LIMIT 1")
def er9b(spark: SparkSession, d: str) -> DataFrame:
    return resolve.best_match(Star(spark, d).entities(), "nation 12", metric=resolve.levenshtein_ratio).select("id", "name", F.round("similarity", 6).alias("similarity"))


@query("er9_best_of_all_names", f"""WITH w AS (SELECT n_nationkey AS key, 'the ' || n_name AS name FROM nation UNION ALL SELECT 1000 + s_suppkey, 'Suplier#' || right(s_name, 9) FROM supplier),
x AS (SELECT key, e.id, {EDIT.format("w.name", "e.name")} AS similarity FROM w JOIN e ON abs(length(trim(w.name)) - length(trim(e.name))) <= 0.2 * greatest(length(trim(w.name)), length(trim(e.name))))
SELECT key, id, round(similarity, 6) AS similarity FROM x WHERE similarity > 0.8 QUALIFY row_number() OVER (PARTITION BY key ORDER BY similarity DESC, id) = 1""")
def er9c(spark: SparkSession, d: str) -> DataFrame:
    """The best entity for every name of a table by one similarity join."""
    g = Star(spark, d)
    nations = g.t("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.concat(F.lit("the "), "n_name").alias("name"))
    suppliers = g.t("supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("key"), F.concat(F.lit("Suplier#"), F.right("s_name", F.lit(9))).alias("name"))
    out = resolve.best_matches(g.entities(), nations.union(suppliers), 0.8, resolve.levenshtein_ratio)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("er9_best_match")
def er9(spark: SparkSession, d: str) -> DataFrame:
    return resolve.best_match(Star(spark, d).entities(), "nation 12").select("id", "name", "similarity")


@query("er10_question_entities", "SELECT id, 1.0::DOUBLE AS score FROM e WHERE contains('what do nation_7 and nation_12 sell in asia', lower(name)) ORDER BY id LIMIT 3")
def er10(spark: SparkSession, d: str) -> DataFrame:
    return resolve.question_entities(Star(spark, d).entities(), "What do NATION_7 and NATION_12 sell in ASIA").select("id", "score")


# drawing


@query("viz1_reasoning_graph", f"SELECT id, CAST(min(step) AS INTEGER) AS first_step FROM (SELECT src AS id, 1 AS step FROM rel WHERE src IN ({TOP5}) UNION ALL SELECT dst, 1 FROM rel WHERE src IN ({TOP5})) GROUP BY id")
def viz1(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    t = g.relationships().join(_top5(g), F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("subject"), F.col("rel_key").alias("relation"), F.col("dst").alias("object"), "confidence", F.lit(1).alias("step"))
    return viz.reasoning_graph(t)[0]


@query("viz2_frames", "SELECT step, list_sort(list(id)) AS ids FROM (SELECT dst AS id, CAST(min(weight) AS BIGINT) AS step FROM rel GROUP BY dst) GROUP BY step")
def viz2(spark: SparkSession, d: str) -> DataFrame:
    return viz.frames(Star(spark, d).relationships(), "dst", "weight")


@query("viz3_styles", """SELECT id, CASE upper(type) WHEN 'SUPPLIER' THEN '#F28E2B' ELSE '#9C9C9C' END AS colour, CAST(least(100, 50 + 5 * mention_count) AS BIGINT) AS size,
['#4E79A7', '#F28E2B', '#E15759', '#76B7B2', '#59A14F', '#EDC948', '#B07AA1', '#FF9DA7', '#9C755F', '#BAB0AC'][1 + community % 10] AS community_colour FROM e JOIN mem USING (id)""")
def viz3(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return g.entities().join(g.membership(), "id").select("id", viz.type_colour(F.col("type")).alias("colour"), viz.node_size(F.col("mention_count")).alias("size"), viz.community_colour(F.col("community")).alias("community_colour"))


@query("viz4_edge_styles", "SELECT src, dst, CAST(CASE WHEN confidence > 0.8 THEN 3 WHEN confidence > 0.6 THEN 2 ELSE 1 END AS INTEGER) AS width, contains(lower(rel_label), 'related') AS dashed FROM rel")
def viz4(spark: SparkSession, d: str) -> DataFrame:
    width, dashed = viz.edge_style(F.col("rel_label"), F.col("confidence"))
    return Star(spark, d).relationships().select("src", "dst", width.alias("width"), dashed.alias("dashed"))


@query("msc9_document_info", "SELECT id, status, version FROM d WHERE id = 'C7'")
def msc9(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).documents().where("id = 'C7'").select("id", "status", "version")


@query("msc10_delete_documents", "SELECT id FROM d WHERE id NOT IN ('C1', 'C2', 'C4')")
def msc10(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).documents().join(_docs(spark), "id", "left_anti").select("id")


@query("msc11_reprocess", "SELECT id, 2 AS version, true AS is_changed FROM d")
def msc11(spark: SparkSession, d: str) -> DataFrame:
    docs = Star(spark, d).documents()
    return incremental.changed(docs, docs, force=True).select("id", "version", "is_changed")


@query("msc12_claims_by_entity", "SELECT subject AS entity_id, status, count(*) AS n FROM (SELECT subject, status, claim_id FROM claim UNION SELECT object, status, claim_id FROM claim) GROUP BY ALL")
def msc12(spark: SparkSession, d: str) -> DataFrame:
    c = Star(spark, d).claims()
    return c.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity_id"), "status", "claim_id").groupBy("entity_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("msc15_two_entities", "SELECT a.id AS id1, b.id AS id2, a.name = b.name AS same_name FROM e a, e b WHERE a.id = 'N1' AND b.id = 'R1'")
def msc15(spark: SparkSession, d: str) -> DataFrame:
    e = Star(spark, d).entities()
    a, b = e.where("id = 'N1'").select(F.col("id").alias("id1"), F.col("name").alias("n1")), e.where("id = 'R1'").select(F.col("id").alias("id2"), F.col("name").alias("n2"))
    return a.join(b).select("id1", "id2", (F.col("n1") == F.col("n2")).alias("same_name"))


