"""Text operators, chunking and extraction on the documents, pages and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import tables
from kgspark.functions import text as T
from kgspark.operators import chunking, extraction, parse
from kgspark.runtime import table

from .base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("src1_markdown_scan", "SELECT '# Item ' || item_id AS paragraph FROM benchmark")
def src1(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as Markdown files and scanned back."""
    from kgspark.runtime import scratch_dir
    from kgspark.sources.files import read_markdown

    rows = table(spark, d, "benchmark").coalesce(1)
    folder = f"{scratch_dir(spark)}/kgspark/markdown-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit("# Item "), F.col("item_id").cast("string"), F.lit("\n\n"), "text").alias("value")).write.text(folder, lineSep="\n\n")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.md"))
    return read_markdown(spark, folder).select(F.explode(T.split_paragraphs(F.col("text"))).alias("paragraph")).where("paragraph like '# Item %'")


@query("txt1_token_count", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS n_tokens FROM documents")
def txt1(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query("txt2_paragraphs", "SELECT item_id, p AS paragraph FROM (SELECT item_id, unnest(list_filter(list_transform(string_split_regex(trim(text || chr(10) || chr(10) || '  end of item  '), '\\n\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS p FROM benchmark)")
def txt2(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit("\n\n  end of item  "))
    return table(spark, d, "benchmark").select("item_id", F.explode(T.split_paragraphs(text)).alias("paragraph"))


@query("txt3_sentences", "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n_sentences FROM documents")
def txt3(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(T.split_sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("txt4_chunks")
def txt4(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, d))


@query("txt5_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def txt5(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("txt6_ids", "SELECT c_custkey, left(md5(lower(trim(c_name)) || ':' || lower(c_mktsegment)), 16) AS entity_id, left(md5(concat_ws(':', c_name, c_mktsegment, 'T', '', '')), 16) AS claim_id FROM customer")
def txt6(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", T.entity_id(F.col("c_name"), F.col("c_mktsegment")).alias("entity_id"), T.claim_id(F.col("c_name"), F.col("c_mktsegment"), F.lit("T"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("claim_id"))


@query("txt7_strip_parens", "SELECT p_partkey, trim(regexp_replace(p_name || ' (' || p_brand || ')', '\\s*\\([^)]*\\)\\s*', '', 'g')) AS name FROM part")
def txt7(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", T.strip_parens(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("txt8_drop_paren_chars", "SELECT p_partkey, replace(replace('(' || p_name || ') ' || p_brand, '(', ''), ')', '') AS name FROM part")
def txt8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.drop_paren_chars(F.concat(F.lit("("), "p_name", F.lit(") "), "p_brand")).alias("name"))


@query("txt9_case_insensitive", "SELECT n_nationkey, lower(n_name) = lower('france') AS is_france FROM nation")
def txt9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", T.same_ignoring_case(F.col("n_name"), F.lit("france")).alias("is_france"))


@query("txt10_prefix_substring", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') AND contains(p_name, 'e')")
def txt10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_brand").startswith("Brand#1") & F.col("p_name").contains("e")).select("p_partkey")


@query("txt11_coalesce", "SELECT l.doc_id AS label_id, d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def txt11(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("label_id"), "toxic")
    return _docs(spark, d).join(labels, F.col("doc_id") == F.col("label_id"), "left").select("label_id", "doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("txt12_slice_size", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS head, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents")
def txt12(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ")
    return _docs(spark, d).select("doc_id", F.array_join(T.take(words, 3), " ").alias("head"), F.size(words).cast("long").alias("n"))


@query("txt13_comprehension", "SELECT o_custkey, list_sort(list_transform(list(o_orderpriority), lambda x: lower(x))) AS names, bool_and(o_orderstatus = 'F') AS all_final FROM orders GROUP BY o_custkey")
def txt13(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.collect_list("o_orderstatus").alias("s"))
    return o.select("o_custkey", F.array_sort(F.transform("p", lambda x: F.lower(x))).alias("names"), F.forall("s", lambda x: x == "F").alias("all_final"))


@query("txt14_case_max", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, greatest(l_discount, l_tax) AS top FROM lineitem")
def txt14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.greatest("l_discount", "l_tax").alias("top"))


@query("txt15_append_unique", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN [n_name] ELSE [n_name, 'nation ' || n_nationkey] END AS aliases FROM nation")
def txt15(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    alias = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")))
    return n.select("n_nationkey", T.append_unique(F.array("n_name"), alias).alias("aliases"))


@query("txt16_scrub", "SELECT doc_id, md5(regexp_replace(chr(1) || text || chr(127), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS plain, md5(regexp_replace(chr(1) || text || chr(127), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g')) AS wide FROM documents")
def txt16(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("\x01"), "text", F.lit("\x7f"))
    return _docs(spark, d).select("doc_id", F.md5(T.scrub(text).cast("binary")).alias("plain"), F.md5(T.scrub(text, wide=True).cast("binary")).alias("wide"))


@query("txt17_strip_fence", f"SELECT item_id, '{{\"id\": ' || item_id || ', \"ok\": true}}' AS json FROM benchmark")
def txt17(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("item_id", T.strip_fence(F.col("reply")).alias("json"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.format_string('```json\n{"id": %s, "ok": true}\n```', F.col("item_id")).alias("reply"))


@query("txt18_parse_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def txt18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", parse.parse_json(F.col("props"), "k long")["k"].alias("k"))


@query("txt19_repair_json", "SELECT item_id, item_id AS id, 'a' || chr(10) || 'b' AS note FROM benchmark")
def txt19(spark: SparkSession, d: str) -> DataFrame:
    broken = table(spark, d, "benchmark").select("item_id", F.format_string('{"id": %s, "note": "a\nb",}', F.col("item_id")).alias("reply"))
    fixed = parse.repaired_json(broken).select("item_id", F.from_json("json", "id long, note string").alias("j"))
    return fixed.select("item_id", "j.id", "j.note")


@query("txt20_truncate", "SELECT doc_id, left(text, 500) AS a, left(text, 100) AS b FROM documents")
def txt20(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.truncate(F.col("text"), 500).alias("a"), T.truncate(F.col("text"), 100).alias("b"))


@query("txt21_scaled_strength", "SELECT p_partkey, least(greatest(coalesce(try_cast(CASE WHEN p_size % 5 = 0 THEN 'abc' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE), 5.0) / 10, 0), 1) AS confidence FROM part")
def txt21(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("p_size") % 5 == 0, "abc").otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.scaled_strength(s).alias("confidence"))


@query("txt22_themes", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS themes, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def txt22(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(T.join_themes(F.array_sort(F.collect_set("o_orderpriority"))).alias("themes"))
    return o.select("o_custkey", "themes", F.size(T.split_themes(F.col("themes"))).cast("long").alias("n"))


@query("txt23_tokens", "SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS n_rank FROM documents")
def txt23(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(T.rank_tokens(F.col("text"))).cast("long").alias("n_rank"))


@query("txt23_question_words", "SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 2) AS words FROM conversations")
def txt23b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.question_words(F.col("text")).alias("words"))


@query("txt24_timestamps")
def txt24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_regionkey", F.current_timestamp().alias("created_at"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


# extraction


def _graph_replies(spark: SparkSession, d: str) -> DataFrame:
    """One reply a part: an entity line, a relationship line and one with too few fields."""
    line = '("entity"|||%s|||%s|||brand %s)\n("relationship"|||%s|||%s|||same brand|||%s)\n("entity"|||short)\n<COMPLETE>'
    p = F.col
    strength = F.when(p("p_size") % 7 == 0, "abc").otherwise(p("p_size").cast("string"))
    return table(spark, d, "part").select(p("p_partkey").cast("string").alias("chunk_id"), F.format_string(line, p("p_name"), p("p_type"), p("p_brand"), p("p_name"), p("p_brand"), strength).alias("reply"))


EXT1 = """SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, 0 AS seq, 'entity' AS kind, p_name AS name, upper(p_type) AS type, NULL AS target, 'brand ' || p_brand AS description, 0.8::DOUBLE AS confidence, NULL::DOUBLE AS strength FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 'relationship', p_name, 'RELATED_TO', p_brand, 'same brand', CASE WHEN p_size % 7 = 0 THEN 0.5 ELSE least(p_size / 10, 1.0) END, CASE WHEN p_size % 7 = 0 THEN 5.0 ELSE p_size END FROM part"""


@query("ext1_parse_graph_lines", EXT1)
def ext1(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_graph_lines(_graph_replies(spark, d))


@query("ext1_parse_graph_replies", EXT1)
def ext1b(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_graph_replies(_graph_replies(spark, d))


EXT2 = "SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, CAST(0 AS INTEGER) AS seq, 'C' || o_custkey AS subject, 'NONE' AS object, 'ORDER' AS claim_type, o_orderstatus AS status, NULL AS start_date, '2024-01-01' AS end_date, o_orderpriority AS description, 'row' AS source_text FROM orders"


def _claim_replies(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    line = "(C%s<|>NONE<|>order<|>%s<|>NONE<|>2024-01-01<|>%s<|>row)\n##\n(too<|>short)\n<|COMPLETE|>"
    return o.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.format_string(line, "o_custkey", "o_orderstatus", "o_orderpriority").alias("reply"))


@query("ext2_parse_claims", EXT2)
def ext2(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_claims(_claim_replies(spark, d))


@query("ext1_graph_tuples_in_sql", EXT1)
def ext1c(spark: SparkSession, d: str) -> DataFrame:
    """From SQL, by the registered table function."""
    tables.register(spark)
    return spark.sql("SELECT r.chunk_id, g.* FROM {r} r, LATERAL parse_graph_tuples(r.reply) g", r=_graph_replies(spark, d))


@query("ext2_claims_in_sql", EXT2)
def ext2b(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT r.chunk_id, c.* FROM {r} r, LATERAL parse_claims(r.reply) c", r=_claim_replies(spark, d))


@query("txt4_chunks_in_sql")
def txt4c(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL chunk_text(d.text) c", d=_docs(spark, d))


@query("ext3_gleaning")
def ext3(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_with_gleaning(chunking.chunk_documents(_docs(spark, d)), ["TERM"])


@query("ext4_dedup_entities", """WITH p AS (SELECT p_brand AS g, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name, p_type AS type, p_partkey AS seq, p_name || p_type AS d, row_number() OVER (PARTITION BY p_brand, upper(p_name), upper(p_type) ORDER BY p_partkey) AS r FROM part)
SELECT g, arg_min(name, seq) AS name, arg_min(type, seq) AS type, string_agg(DISTINCT d, ' | ' ORDER BY d) AS description, 0.8::DOUBLE AS confidence, count(*) AS mention_count FROM p GROUP BY g, upper(name), upper(type)""")
def ext4(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name"), F.col("p_type").alias("type"), F.concat("p_name", "p_type").alias("description"), F.lit(0.8).alias("confidence"), F.col("p_partkey").alias("seq"))
    return extraction.dedup_entities(p, "g")


@query("ext5_dedup_relationships", """SELECT arg_min(p_name, p_partkey) AS source, arg_min(p_brand, p_partkey) AS target, 'RELATED_TO' AS type, 'same' AS description, max(p_size)::DOUBLE AS strength, least(max(p_size) / 10, 1.0) AS confidence, count(*) AS weight FROM part GROUP BY upper(p_name), upper(p_brand)""")
def ext5(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("target"), F.lit("RELATED_TO").alias("type"), F.lit("same").alias("description"), size.alias("strength"), F.least(size / 10, F.lit(1.0)).alias("confidence"), F.col("p_partkey").alias("seq"))
    return extraction.dedup_relationships(p)


@query("ext6_entities_with_fallback")
def ext6(spark: SparkSession, d: str) -> DataFrame:
    """Tuples first; replies without any are read as JSON."""
    tuples = parse.parse_graph_lines(_graph_replies(spark, d)).where("kind = 'entity'").select("chunk_id", "name", "type")
    replies = _replies(spark, d).select(F.col("item_id").cast("string").alias("chunk_id"), T.strip_fence(F.col("reply")).alias("json"))
    found = replies.join(tuples.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", F.inline(F.from_json("json", "entities array<struct<name: string, type: string>>")["entities"]))
    return tuples.unionByName(found)


@query("ext7_known_relationships", "SELECT s_name AS source, n_name AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0")
def ext7(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    rel = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"))
    known = n.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("name")).union(table(spark, d, "supplier").select(F.concat(F.lit(" "), "s_name")))
    return extraction.between_known(rel, known)


@query("ext8_claims", """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 0 AS seq, 'doc ' || doc_id AS subject, 'NONE' AS object, 'QUALITY' AS claim_type, CASE WHEN quality = 1 THEN 'TRUE' ELSE 'FALSE' END AS status,
NULL::VARCHAR AS start_date, NULL::VARCHAR AS end_date, 'label' AS description, 'labels' AS source_text FROM labels""")
def ext8(spark: SparkSession, d: str) -> DataFrame:
    """Claims from documents' labels, written and read in the claim format."""
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"), F.format_string("(doc %s<|>NONE<|>quality<|>%s<|>NONE<|>NONE<|>label<|>labels)<|COMPLETE|>", "doc_id", F.when(F.col("quality") == 1, "TRUE").otherwise("FALSE")).alias("reply"))
    return parse.parse_claims(rows)


@query("ext9_chunks_with_entities")
def ext9(spark: SparkSession, d: str) -> DataFrame:
    units = chunking.chunk_documents(_docs(spark, d))
    found = extraction.extract_with_gleaning(units, ["TERM"], passes=0).where("kind = 'entity'")
    return extraction.with_entities(units, found).select("chunk_id", "document_id")


@query("ext10_consolidate", "SELECT upper(p_name) AS name_key, upper(p_type) AS type_key, CAST(count(DISTINCT p_brand) AS INTEGER) AS n_descriptions, string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS description FROM part GROUP BY ALL")
def ext10(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"))
    return extraction.consolidate_descriptions(p)


@query("ext11_structured_replies")
def ext11(spark: SparkSession, d: str) -> DataFrame:
    """Events, attributes and coreference replies parsed with one schema, nulls where a part is missing."""
    schema = "events array<struct<name: string, date: string>>, attributes map<string, string>, resolved_text string"
    rows = table(spark, d, "orders").select("o_orderkey", F.format_string('{"events": [{"name": "order %s", "date": "%s"}], "attributes": {"priority": "%s"}}', F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")).alias("reply"))
    return rows.select("o_orderkey", parse.parse_json(F.col("reply"), schema).alias("j")).select("o_orderkey", F.col("j.events")[0]["date"].alias("date"), F.col("j.attributes")["priority"].alias("priority"), "j.resolved_text")


@query("ext12_classify", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(overall|summar\\w*|themes?|trends?|overview)\\b') THEN 'global' WHEN regexp_matches(lower(text), '\\b(why|how|relat\\w*|connect\\w*|between|path)\\b') THEN 'tog'
WHEN regexp_matches(lower(text), '\\b(who|what|where|when|which)\\b') THEN 'local' ELSE 'hybrid' END AS route FROM conversations""")
def ext12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", extraction.classify_question(F.col("text")).alias("route"))


@query("ext13_prompts", "SELECT item_id, 'Name the entities.' || chr(10) || chr(10) || 'Text:' || chr(10) || text AS prompt FROM benchmark")
def ext13(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators.clients import prompt

    return table(spark, d, "benchmark").select("item_id", F.replace(F.lit(prompt("Name the entities.", text="{text}")), F.lit("{text}"), F.col("text")).alias("prompt"))


@query("ext15_embeddings")
def ext15(spark: SparkSession, d: str) -> DataFrame:
    return extraction.embed(table(spark, d, "benchmark")).select("item_id", "embedding")
