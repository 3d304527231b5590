"""Ranking, reasoning, global questions, analytics and streaming queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import analytics, beam, build, globalqa, graph, incremental, rank, reason, scoring
from kgspark.operators.chunking import ChunkSettings
from kgspark.operators.numbering import numbered
from kgspark.runtime import materialize, scratch_dir, table
from kgspark.sources.tables import TableStore
from kgspark.streaming import cache, ingest
from kgspark.streaming import events as stream

from .base import STAR_SQL, Registry, Star
from .star import TOP5, _top5

query = Registry(STAR_SQL)
QUERIES, SQL = query.queries, query.sql


def bm25_sql(rows: str, keys: str, text: str, question: str, normalise: bool = True) -> str:
    """DuckDB SQL of BM25 over a relation ``rows`` with unique ``keys``."""
    on = " AND ".join(f"s.{k} = r.{k}" for k in keys.split(", "))
    score = "coalesce(s.score, 0)"
    top = f"{score} / CASE WHEN (SELECT max(score) FROM s) > 0 THEN (SELECT max(score) FROM s) ELSE 1 END" if normalise else score
    return f"""r AS (SELECT {keys}, list_filter(string_split_regex(lower({text}), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS tok FROM {rows}),
w AS (SELECT {keys}, len(tok) AS dl, unnest(tok) AS w FROM r), tot AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM r),
idf0 AS (SELECT w, ln(any_value(n) - count(DISTINCT ({keys})) + 0.5) - ln(count(DISTINCT ({keys})) + 0.5) AS idf FROM w, tot GROUP BY w),
q AS (SELECT w, count(*) AS times FROM (SELECT unnest(string_split(lower('{question}'), ' ')) AS w) GROUP BY w),
idf AS (SELECT w, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
tf AS (SELECT {keys}, dl, w, count(*) AS tf FROM w GROUP BY ALL),
s AS (SELECT {keys}, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (w) JOIN idf USING (w), tot GROUP BY ALL)
SELECT {", ".join("r." + k for k in keys.split(", "))}, round({top}, 4) AS score FROM r LEFT JOIN s ON {on}"""


QUESTION = "small economy promo brand#12"


@query("rnk1_bm25_relations", f"""WITH ks AS (SELECT DISTINCT rel_key || ' ' || p_type AS rel_key FROM rel JOIN part ON dst = 'P' || p_partkey), {bm25_sql("ks", "rel_key", "replace(rel_key, '_', ' ')", QUESTION)}""")
def rnk1(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    part = g.t("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("dst"), "p_type")
    keys = g.relationships().join(part, "dst").select(F.concat_ws(" ", "rel_key", "p_type").alias("rel_key")).distinct()
    return rank.bm25(keys, QUESTION, F.translate("rel_key", "_", " "), ["rel_key"]).withColumn("score", F.round("score", 4))


@query("rnk2_bm25_entities", f"""WITH {bm25_sql("e", "id", "concat_ws(' ', name, description)", "small supplier nation 7 brand#12")}""")
def rnk2(spark: SparkSession, d: str) -> DataFrame:
    e = Star(spark, d).entities()
    return rank.bm25(e, "small supplier nation 7 brand#12", F.concat_ws(" ", "name", "description"), ["id"]).withColumn("score", F.round("score", 4))


@query("rnk2_bm25_documents", f"""WITH {bm25_sql("documents", "doc_id", "text", "the and token of worthless", False)}""")
def rnk2b(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return rank.bm25(docs, "the and token of worthless", F.col("text"), ["doc_id"], normalise=False).withColumn("score", F.round("score", 4))


@query("rnk3_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def rnk3(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.join(F.broadcast(q)).select("vec_id", F.round(rank.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@query("rnk4_merge_scores", "SELECT id, CASE WHEN name LIKE 'S%' AND mention_count % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS score FROM e")
def rnk4(spark: SparkSession, d: str) -> DataFrame:
    e = Star(spark, d).entities()
    scores = e.where("name like 'S%' and mention_count % 2 = 0").select("id", F.lit(0.9).alias("score"))
    return rank.merge_scores(e.select("id"), scores, "id")


@query("rnk5_constant", "SELECT id, 0.5::DOUBLE AS score FROM e")
def rnk5(spark: SparkSession, d: str) -> DataFrame:
    return rank.strategy("llm")(Star(spark, d).entities(), "any", F.col("name"), ["id"])


@query("rnk6_strategies")
def rnk6(spark: SparkSession, d: str) -> DataFrame:
    e = Star(spark, d).entities().where("type = 'NATION'")
    out = None
    for name in sorted(rank.STRATEGIES):
        part = rank.strategy(name)(e, "germany", F.col("name"), ["id"]).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("rnk7_vector_search", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, a.vec_id LIMIT 10")
def rnk7(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()[0]
    return rank.vector_search(v, list(q), 10).withColumn("score", F.round("score", 6))


# reasoning


@query("tog1_topic_entities")
def tog1(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators import resolve

    return resolve.question_entities(Star(spark, d).entities(), "which supplers in nation_7 sell to asia").select("id", "name", "score")


@query("tog2_entity_with_texts", "SELECT e.id, e.name, list(text ORDER BY text_unit_id) AS texts FROM e JOIN (SELECT entity_id, text_unit_id, text FROM m JOIN tu ON tu.id = text_unit_id QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY text_unit_id) <= 3) x ON x.entity_id = e.id WHERE e.id IN ('S1', 'P1', 'P2') GROUP BY ALL")
def tog2(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    wanted = g.entities().where(F.col("id").isin("S1", "P1", "P2"))
    units = g.text_units().select(F.col("id").alias("text_unit_id"), "text")
    joined = g.mentions().join(F.broadcast(wanted.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi").join(units, "text_unit_id")
    texts = graph.top_per_group(joined, ["entity_id"], [F.col("text_unit_id")], 3).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("text_unit_id", "text"))), lambda x: x["text"]).alias("texts"))
    return wanted.join(texts, F.col("id") == F.col("entity_id")).select("id", "name", "texts")


STATS = f"st AS (SELECT rel_key, count(*) AS frequency, avg(confidence) AS avg_confidence FROM und WHERE src IN ({TOP5}) GROUP BY rel_key ORDER BY frequency DESC, rel_key LIMIT 50), st2 AS (SELECT * FROM st WHERE rel_key NOT IN ('Brand#13'))"


@query("tog3_explore", f"""WITH {STATS}, {bm25_sql("st2", "rel_key", "replace(rel_key, '_', ' ')", "which brand#12 in nation")} ORDER BY score DESC, r.rel_key LIMIT 3""")
def tog3(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return reason.explore(g.relationships(), _top5(g), "which brand#12 in nation", ["Brand#13"]).select("rel_key", F.round("score", 4).alias("score"))


@query("tog4_expand")
def tog4(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    keys = spark.createDataFrame([("Brand#12",), ("IN_NATION",)], "rel_key string")
    options = reason.candidates(g.relationships(), g.entities(), _top5(g), keys)
    return reason.expand(options, "small ring brand#12").select("src", "rel_key", "dst", F.round("score", 6).alias("score"))


@query("tog6_reasoning_loop")
def tog6(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    e, r, m, u = materialize(g.entities(), "entities"), materialize(g.relationships(), "edges"), g.mentions(), g.text_units()
    out = reason.answer("what does nation_7 supply", e, r, m, u, reason.Config(search_depth=2))
    return spark.createDataFrame(out.triplets, "subject string, relation string, object string, source string, confidence double")


def _beam_sql(depth: int, width: int = 3, retain: int = 5) -> str:
    """Triplets of the set-based loop with equal scores, one group of CTEs a depth."""
    parts = ["f1 AS (SELECT s_suppkey AS q, 'N' || s_nationkey AS src FROM supplier)", "x0 AS (SELECT NULL::BIGINT AS q, '' AS rel_key WHERE false)", "s0 AS (SELECT q, src AS id FROM f1)"]
    for k in range(1, depth + 1):
        parts += [
            f"st{k} AS (SELECT * FROM (SELECT * FROM (SELECT q, rel_key, count(*) AS n FROM f{k} JOIN und USING (src) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, rel_key) <= 50) ANTI JOIN x{k - 1} USING (q, rel_key))",
            f"c{k} AS (SELECT q, rel_key FROM st{k} QUALIFY row_number() OVER (PARTITION BY q ORDER BY rel_key) <= {width})",
            f"o{k} AS (SELECT f.q, f.src, c.rel_key, u.dst, max(u.confidence) AS conf, any_value(e.mention_count) AS mc FROM f{k} f JOIN c{k} c ON c.q = f.q JOIN und u ON u.src = f.src AND u.rel_key = c.rel_key JOIN e ON e.id = u.dst GROUP BY ALL)",
            f"p{k} AS (SELECT * FROM o{k} QUALIFY row_number() OVER (PARTITION BY q, src, rel_key ORDER BY conf DESC, mc DESC, dst) = 1)",
            f"n{k} AS (SELECT q, dst, max(conf) AS conf FROM p{k} WHERE (q, dst) NOT IN (SELECT q, id FROM s{k - 1}) GROUP BY q, dst)",
            f"x{k} AS (SELECT * FROM x{k - 1} UNION ALL SELECT * FROM c{k})",
            f"s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT q, dst FROM n{k})",
            f"f{k + 1} AS (SELECT q, dst AS src FROM n{k} QUALIFY row_number() OVER (PARTITION BY q ORDER BY conf DESC, dst) <= {retain})",
        ]
    rows = " UNION ALL ".join(f"SELECT q AS question_id, {k} AS depth, src AS subject, rel_key AS relation, dst AS object, conf AS confidence FROM p{k}" for k in range(1, depth + 1))
    return f"WITH {', '.join(parts)} {rows}"


@query("tog6_beam_search", _beam_sql(2))
def tog6_all(spark: SparkSession, d: str) -> DataFrame:
    """A question for every supplier, from its nation, all of them by the same joins."""
    g = Star(spark, d)
    s = g.t("supplier")
    questions = s.select(F.col("s_suppkey").cast("long").alias("question_id"), F.concat(F.lit("zzz sold by "), "s_name").alias("question"), F.lit(None).cast("array<string>").alias("document_ids"))
    starts = s.select(F.col("s_suppkey").cast("long").alias("question_id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("id"))
    out = beam.reason_all(questions, starts, g.entities(), g.relationships(), reason.Config(search_depth=2), scorer=scoring.constant)
    return out.triplets


@query("tog6_document_scope", """WITH w AS (SELECT c_custkey AS q, 'C' || c_custkey AS document_id FROM customer), sc AS (SELECT DISTINCT q, entity_id AS id FROM w JOIN tu USING (document_id) JOIN m ON m.text_unit_id = tu.id),
f AS (SELECT q, min(id) AS src FROM sc WHERE id LIKE 'S%' GROUP BY q),
r AS (SELECT f.q, rel_key, count(*) AS frequency, sum(confidence) / count(*) AS avg_confidence FROM f JOIN und USING (src) JOIN sc ON sc.q = f.q AND sc.id = und.dst WHERE confidence > 0.3 GROUP BY ALL)
SELECT q AS question_id, rel_key, frequency, round(avg_confidence, 6) AS avg_confidence FROM r QUALIFY row_number() OVER (PARTITION BY q ORDER BY frequency DESC, rel_key) <= 50""")
def tog6_scope(spark: SparkSession, d: str) -> DataFrame:
    """Relations around one supplier of each customer's documents, inside those documents."""
    g = Star(spark, d)
    questions = g.t("customer").select(F.col("c_custkey").cast("long").alias("question_id"), F.array(F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("document_ids"))
    scope = materialize(beam.scopes(questions, g.mentions(), g.text_units()), "scope")
    front = scope.where("id like 'S%'").groupBy("question_id").agg(F.min("id").alias("src")).withColumn("scoped", F.lit(True))
    both = materialize(graph.undirected(g.relationships(), "rel_key", "confidence"), "edges")
    return beam.relations_of(front, both, scope).withColumn("avg_confidence", F.round("avg_confidence", 6))


def _nation_questions(g: Star) -> DataFrame:
    """Questions that name a nation exactly, misspell a supplier, or name nothing."""
    n, s = g.t("nation"), g.t("supplier")
    named = n.select(F.col("n_nationkey").cast("long").alias("question_id"), F.concat(F.lit("what is sold in "), "n_name", F.lit(" today")).alias("question"))
    return named.union(s.select((F.col("s_suppkey") + 1000).cast("long"), F.concat(F.lit("tell me of suplier"), F.right("s_name", F.lit(9))))).withColumn("document_ids", F.lit(None).cast("array<string>"))


@query("tog1_topic_entities_of_all")
def tog1_all(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return beam.topic_entities(_nation_questions(g), g.entities()).select("question_id", "id", F.round("score", 6).alias("score"), "stage")


@query("tog8_fallback_of_all")
def tog8_all(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return beam.fallback(_nation_questions(g), g.entities())


RELATION_SETS = "SELECT 'S' || s_suppkey AS src, 'nation ' || s_nationkey || ' brand#12 brand#34' AS question FROM supplier"


@query("rnk4_client_scores", f"""WITH q AS ({RELATION_SETS}), r AS (SELECT DISTINCT src, rel_key FROM q JOIN rel USING (src))
SELECT src AS question_id, rel_key, CASE WHEN rel_key LIKE 'Brand#1%' THEN 0.9 WHEN rel_key LIKE 'Brand#2%' THEN 0.5 ELSE 0.1 END::DOUBLE AS score FROM r""")
def rnk4b(spark: SparkSession, d: str) -> DataFrame:
    """A client scores the relations of every supplier; what its reply leaves out scores 0.5."""
    g = Star(spark, d)
    questions = g.t("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("question_id"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"), F.lit(" brand#12 brand#34")).alias("question"))
    rows = g.relationships().select(F.col("src").alias("question_id"), "rel_key", F.lit("").alias("text")).join(questions.select("question_id"), "question_id", "left_semi").distinct()
    return scoring.by_client(brand_client, rate=100_000.0)(rows, questions, "rel_key")


def brand_client():  # noqa: ANN201
    """Offline stand-in for a client: replies with scores for the candidates that it knows."""
    import json
    import re

    def reply(asked: str) -> str:
        names = [n.removesuffix(": ") for n in asked.split("Candidates:\n")[1].split("\n")]
        return json.dumps({"scores": [{"name": n, "score": 0.9 if re.match("Brand#1", n) else 0.1} for n in names if not re.match("Brand#2", n)]})

    return reply


@query("tog7_answer_context", f"""WITH c AS (SELECT text_unit_id, count(DISTINCT entity_id) AS n, start_char, text FROM m JOIN tu ON tu.id = text_unit_id WHERE entity_id IN ({TOP5}) GROUP BY ALL ORDER BY n DESC, start_char, text_unit_id LIMIT 5)
SELECT string_agg(t, chr(10) ORDER BY part, k1, k) AS context FROM (SELECT * FROM (SELECT 0 AS part, 0 AS k1, id AS k, left(name || ': ' || description, 500) AS t FROM e WHERE id IN ({TOP5}) ORDER BY id LIMIT 3) UNION ALL SELECT * FROM (SELECT 1, 0, text_unit_id, left(text, 500) FROM c ORDER BY n DESC, start_char, text_unit_id LIMIT 3))""")
def tog7(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    top = _top5(g)
    chunks = reason.evidence(g.mentions(), g.text_units(), top)
    return reason.answer_context(g.entities().join(F.broadcast(top), "id", "left_semi"), chunks)


@query("tog5_sufficiency", """WITH q(question) AS (VALUES ('nation_7 nation_9'), ('nation_7 atlantis'), (''), ('to be')), w AS (SELECT question, unnest(list_distinct(list_filter(string_split(question, ' '), lambda x: len(x) > 2))) AS w FROM q)
SELECT question, coalesce((SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM nation WHERE contains(lower(n_name), w.w)) THEN 1.0 ELSE 0.0 END) FROM w WHERE w.question = q.question), 1.0)::DOUBLE AS score FROM q""", prelude=False)
def tog5(spark: SparkSession, d: str) -> DataFrame:
    names = [r["n_name"] for r in table(spark, d, "nation").select("n_name").collect()]
    rows = [(q, reason.sufficient(q, names)) for q in ("nation_7 nation_9", "nation_7 atlantis", "", "to be")]
    return spark.createDataFrame(rows, "question string, score double")


@query("tog8_fallback")
def tog8(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.operators import resolve

    return resolve.question_entities(Star(spark, d).entities(), "anything about nation_9", n=2).select("id", "name", F.lit(0.1).alias("confidence"))


@query("tog9_config", "SELECT * FROM (VALUES (1, 3, 3, 'bm25', 0), (2, 0, 3, 'bm25', 1), (3, 11, 9, 'other', 3)) t(id, width, depth, method, n_problems)", prelude=False)
def tog9(spark: SparkSession, d: str) -> DataFrame:
    cases = [(1, 3, 3, "bm25"), (2, 0, 3, "bm25"), (3, 11, 9, "other")]
    rows = [(i, w, p, m, len(reason.Config(search_width=w, search_depth=p, pruning_method=m).problems())) for i, w, p, m in cases]
    return spark.createDataFrame(rows, "id int, width int, depth int, method string, n_problems int")


@query("glb1_batches", "SELECT community, CAST((row_number() OVER (ORDER BY community) - 1) // 10 AS BIGINT) AS batch FROM (SELECT DISTINCT community FROM mem)")
def glb1(spark: SparkSession, d: str) -> DataFrame:
    return globalqa.batches(Star(spark, d).membership().select("community").distinct()).select("community", "batch")


@query("glb1_map_reduce")
def glb1b(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("community"), F.concat(F.lit("Suppliers of "), "n_name", F.lit(".")).alias("summary"))
    parts, _ = globalqa.map_reduce(n, "suppliers of nation_7")
    return parts.select("batch", "summary", F.round("score", 6).alias("score"))


def adding_client():  # noqa: ANN201
    """Offline stand-in for a client whose answer shows that no partial answer was lost: the sum of the numbers it reads."""
    import re

    return lambda asked: str(sum(map(int, re.findall(r"\d+", asked))))


@query("glb1_reduce_by_rounds", "SELECT CAST(sum(c_custkey) AS VARCHAR) AS answer, count(*) AS n_parts, 0::BIGINT AS n_errors FROM customer", prelude=False)
def glb1c(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), F.col("c_custkey").cast("string").alias("summary"))
    return globalqa.reduce_by_rounds(parts, "how much is it", adding_client, budget=100, spacing=0.0).select("answer", "n_parts", "n_errors")


@query("glb2_routes", """SELECT item_id, CASE WHEN regexp_matches(lower(text), '\\b(overall|summar\\w*|themes?|trends?|overview)\\b') THEN 'global' WHEN regexp_matches(lower(text), '\\b(why|how|relat\\w*|connect\\w*|between|path)\\b') THEN 'tog'
WHEN regexp_matches(lower(text), '\\b(who|what|where|when|which)\\b') THEN 'local' ELSE 'hybrid' END AS route FROM benchmark""", prelude=False)
def glb2(spark: SparkSession, d: str) -> DataFrame:
    return globalqa.route(table(spark, d, "benchmark"), "text").select("item_id", "route")


@query("glb3_claims_answer", f"""WITH c AS (SELECT claim_id, description || ' ' || status AS t FROM claim WHERE subject = 'S1'), {bm25_sql("c", "claim_id", "t", "brand#12 true")} ORDER BY score DESC, r.claim_id LIMIT 20""")
def glb3(spark: SparkSession, d: str) -> DataFrame:
    c = Star(spark, d).claims().where("subject = 'S1'").select("claim_id", F.concat_ws(" ", "description", "status").alias("description"))
    out = globalqa.claims_for_question(c, "brand#12 true", 1000).select("claim_id", F.round("score", 4).alias("score"))
    return out.orderBy(F.desc("score"), "claim_id").limit(20)


@query("glb3_local_answer", """SELECT text_unit_id, count(DISTINCT entity_id) AS n_entities FROM m JOIN tu ON tu.id = text_unit_id WHERE entity_id IN (SELECT 'N7' UNION SELECT dst FROM und WHERE src = 'N7')
GROUP BY text_unit_id, start_char ORDER BY count(DISTINCT entity_id) DESC, start_char, text_unit_id LIMIT 10""")
def glb3b(spark: SparkSession, d: str) -> DataFrame:
    """Local answer: the neighbourhood of the question's entities and its evidence."""
    g = Star(spark, d)
    near = graph.ego(g.relationships(), spark.createDataFrame([("N7",)], "id string"), 1)
    return reason.evidence(g.mentions(), g.text_units(), near.select("id"), 10).select("text_unit_id", "n_entities")


@query("glb4_batch_validation", "SELECT * FROM (VALUES ('one', true), ('none', false), ('eleven', false), ('long', false)) t(name, accepted)", prelude=False)
def glb4(spark: SparkSession, d: str) -> DataFrame:
    def ok(questions: list[str]) -> bool:
        try:
            return bool(globalqa.valid_questions(questions))
        except ValueError:
            return False

    cases = {"one": ["q"], "none": [], "eleven": ["q"] * 11, "long": ["q" * 1001]}
    return spark.createDataFrame([(k, ok(v)) for k, v in cases.items()], "name string, accepted boolean")


# analytics


@query("ana1_query_metrics", """SELECT id, n_steps AS total_steps, n_triplets AS total_triplets, round(coalesce(n_entities / nullif(n_steps, 0), 0), 6) AS entities_per_step, round(coalesce(n_relations / nullif(n_steps, 0), 0), 6) AS relations_per_step,
round(coalesce(n_triplets / nullif(n_entities, 0), 0), 6) AS efficiency, round(n_steps / search_depth, 6) AS depth_utilisation FROM log""")
def ana1(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.query_metrics(Star(spark, d).log())
    return out.withColumns({c: F.round(c, 6) for c in ("entities_per_step", "relations_per_step", "efficiency", "depth_utilisation")})


@query("ana2_aggregates", """SELECT count(*) AS n_queries, round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(processing_time_ms), 4) AS mean_ms, min(processing_time_ms) AS min_ms, max(processing_time_ms) AS max_ms,
round(avg(CASE WHEN confidence_score > 0 THEN confidence_score END), 6) AS mean_confidence FROM log""")
def ana2(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.aggregate_metrics(Star(spark, d).log())
    return out.withColumns({"success_rate": F.round("success_rate", 6), "mean_ms": F.round("mean_ms", 4), "mean_confidence": F.round("mean_confidence", 6)})


@query("ana2_status_mode", "SELECT status, count(*) AS n FROM log GROUP BY status ORDER BY n DESC, min(seq) LIMIT 1")
def ana2b(spark: SparkSession, d: str) -> DataFrame:
    return analytics.status_mode(Star(spark, d).log())


@query("ana2_usage", "SELECT method, count(*) AS n FROM log GROUP BY method")
def ana2c(spark: SparkSession, d: str) -> DataFrame:
    return analytics.usage(Star(spark, d).log(), "method")


@query("ana3_p95", """WITH x AS (SELECT user_id, list(processing_time_ms ORDER BY processing_time_ms) AS v, avg(processing_time_ms) AS mean FROM log GROUP BY user_id),
y AS (SELECT user_id, v, mean, len(v) AS m, greatest(1, least((19 * (len(v) + 1)) // 20, len(v) - 1)) AS j FROM x)
SELECT user_id, round(CASE WHEN m < 20 THEN mean ELSE (v[j] * (20 - (19 * (m + 1) - 20 * j)) + v[j + 1] * (19 * (m + 1) - 20 * j)) / 20 END, 4) AS p95 FROM y""")
def ana3(spark: SparkSession, d: str) -> DataFrame:
    return analytics.p95_ranked(Star(spark, d).log(), "processing_time_ms", "user_id").withColumn("p95", F.round("p95", 4))


@query("ana4_histogram", """WITH b AS (SELECT min(processing_time_ms) AS lo, max(processing_time_ms) AS hi FROM log)
SELECT CAST(least(floor((processing_time_ms - lo) / ((hi - lo) / 5)), 4) AS INTEGER) AS bin, count(*) AS n FROM log, b WHERE processing_time_ms < hi GROUP BY 1""")
def ana4(spark: SparkSession, d: str) -> DataFrame:
    return analytics.histogram(Star(spark, d).log(), "processing_time_ms").select("bin", "n")


@query("ana5_trend", """WITH r AS (SELECT processing_time_ms AS v, row_number() OVER (ORDER BY ts, seq) AS r, count(*) OVER () AS n FROM log), h AS (SELECT avg(v) FILTER (r <= n // 2) AS a, avg(v) FILTER (r > n // 2) AS b FROM r)
SELECT round(a, 4) AS first, round(b, 4) AS second, CASE WHEN abs((b - a) / greatest(abs(a), 0.001)) < 0.05 THEN 'stable' WHEN b > a THEN 'increasing' ELSE 'decreasing' END AS trend FROM h""")
def ana5(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.trend(Star(spark, d).log(), "processing_time_ms", ["ts", "seq"])
    return out.withColumns({"first": F.round("first", 4), "second": F.round("second", 4)})


@query("ana6_insights", """SELECT method, list_filter([CASE WHEN avg(processing_time_ms) > 5000 THEN 'slow average response' END, CASE WHEN avg(n_steps) > 3 THEN 'many reasoning steps' END, CASE WHEN avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0 END) < 0.95 THEN NULL END], lambda x: x IS NOT NULL) AS insights FROM log GROUP BY method""")
def ana6(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d).log().groupBy("method").agg(F.avg("processing_time_ms").alias("ms"), F.avg("n_steps").alias("steps"))
    return g.select("method", analytics.insights(F.col("ms"), F.col("steps"), F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("insights"))


@query("ord9_halves", "SELECT half, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY ts, seq) <= (count(*) OVER ()) // 2 THEN 1 ELSE 2 END AS half FROM log) GROUP BY half")
def ord9(spark: SparkSession, d: str) -> DataFrame:
    placed = numbered(Star(spark, d).log().select("ts", "seq"), ["ts", "seq"])
    half = F.when(F.col("r") <= placed.count() // 2, 1).otherwise(2)
    return placed.groupBy(half.alias("half")).agg(F.count(F.lit(1)).alias("n"))


@query("inc4_metrics_cache", "SELECT id FROM log WHERE ts > TIMESTAMP '2024-01-30 23:58:00' - INTERVAL 300 SECOND AND ts <= TIMESTAMP '2024-01-30 23:58:00'")
def inc4(spark: SparkSession, d: str) -> DataFrame:
    from kgspark.sources.cache import ResultCache

    log = Star(spark, d).log().select("id", F.col("ts").alias("stored_at"))
    return ResultCache(ttl_seconds=300).live(log, F.lit("2024-01-30 23:58:00").cast("timestamp_ntz")).select("id")


ENTRIES = """ev AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 10 = 0 THEN 'write' ELSE 'put' END AS op, event_type AS value, ts AS t0 FROM events),
nx AS (SELECT *, lead(t0) OVER w AS next_at, lead(op) OVER w AS next_op, t0 + INTERVAL 1 HOUR AS expiry FROM ev WINDOW w AS (PARTITION BY key ORDER BY t0, op, value)),
en AS (SELECT key, value, t0 AS stored_at, least(expiry, coalesce(next_at, expiry)) AS ended_at, CASE WHEN coalesce(next_at, expiry) >= expiry THEN 'expired' WHEN next_op = 'put' THEN 'replaced' ELSE 'purged' END AS why FROM nx WHERE op = 'put'),
shown AS (SELECT key, value, epoch_us(stored_at) AS stored_at, epoch_us(ended_at) AS ended_at, why FROM en WHERE ended_at > stored_at)"""


def _cache_events(events: DataFrame) -> DataFrame:
    """Every event stores a value under its user; every tenth changes what the user's entry came from."""
    return events.select(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_id") % 10 == 0, "write").otherwise("put").alias("op"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def _in_micros(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.unix_micros(c) for c in ("stored_at", "ended_at")})


@query("inc4_cache_entries", f"WITH {ENTRIES} SELECT * FROM shown", prelude=False)
def inc4b(spark: SparkSession, d: str) -> DataFrame:
    return _in_micros(cache.entries(_cache_events(table(spark, d, "events")), 3600))


@query("inc4_cache_stream", f"WITH {ENTRIES} SELECT * FROM shown WHERE (why = 'expired' AND ended_at <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)) OR (why <> 'expired' AND ended_at < (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events))", prelude=False)
def inc4c(spark: SparkSession, d: str) -> DataFrame:
    """The entries whose end the stream is sure of once all events are in: those that ended before the last watermark."""
    return _in_micros(stream.run_available(cache.entry_stream(_cache_events(stream.read_events(spark, d)), 3600), f"cache_{uuid4().hex}"))


@query("inc5_look_back", "SELECT id FROM log WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR ORDER BY ts DESC, seq DESC LIMIT 1000")
def inc5(spark: SparkSession, d: str) -> DataFrame:
    return analytics.look_back(Star(spark, d).log(), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 24).select("id")


@query("inc2_incremental_pipeline")
def inc2(spark: SparkSession, d: str) -> DataFrame:
    """Changed documents only: their text units, mentions and counts are rebuilt."""
    g = Star(spark, d)
    docs = g.documents()
    new = docs.withColumn("content_hash", F.when(F.col("id").isin("C1", "C2", "C4"), F.lit("new")).otherwise(F.col("content_hash")))
    hit = incremental.changed(new, docs).where("is_changed").select("id")
    left = incremental.delete_documents(hit, g.text_units(), g.mentions(), g.entities(), g.claims())
    again = incremental.mentions_of(hit, g.text_units(), g.mentions())
    found = again.join(g.entities().select(F.col("id").alias("entity_id"), "name", "type", "description", "confidence"), "entity_id").withColumn("seq", F.col("text_unit_id"))
    return build.upsert_entities(left["entities"], found).select("id", "name", "type", "mention_count")


@query("inc2_ingest_batches", "SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END AS version, 'completed' AS status FROM benchmark", prelude=False)
def inc2b(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark texts as uploads, then again with every third one changed; the second batch comes twice."""
    store = TableStore(spark, f"{scratch_dir(spark)}/kgspark/store-{uuid4().hex}", ingest.SCHEMAS)
    texts = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("/"), "item_id", F.lit(".md")).alias("path"), "item_id", "text")
    hashed = lambda x: x.select("id", "path", "text", F.sha2("text", 256).alias("content_hash"))
    again = texts.withColumn("text", F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" Zed met Yan."))).otherwise(F.col("text")))
    run = ingest.Ingest(store, settings=ChunkSettings(least=1))
    for number, batch in enumerate((texts, again)):
        run(hashed(batch), number)
    run(hashed(again), 1)
    return store.read("documents").select("id", "version", "status")


# query log and conversations


@query("msc6_reasoning_json", f"SELECT src, to_json(list_sort(list(struct_pack(rel_key := rel_key, dst := dst)))) AS path FROM rel WHERE src IN ({TOP5}) GROUP BY src")
def msc6(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return g.relationships().join(_top5(g), F.col("src") == F.col("id"), "left_semi").groupBy("src").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rel_key", "dst")))).alias("path"))


@query("msc7_query_by_id", "SELECT id, method FROM log WHERE id = 17 AND user_id = (SELECT user_id FROM log WHERE id = 17)")
def msc7(spark: SparkSession, d: str) -> DataFrame:
    log = Star(spark, d).log()
    owner = log.where("id = 17").select("user_id")
    return log.where("id = 17").join(owner, "user_id", "left_semi").select("id", "method")


@query("msc8_recent", "SELECT id, method = 'click' AS is_click, (SELECT count(*) FROM log WHERE user_id = 7) AS total FROM log WHERE user_id = 7 ORDER BY ts DESC, seq DESC LIMIT 10")
def msc8(spark: SparkSession, d: str) -> DataFrame:
    mine = Star(spark, d).log().where("user_id = 7")
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    return mine.orderBy(F.desc("ts"), F.desc("seq")).limit(10).join(F.broadcast(total)).select("id", (F.col("method") == "click").alias("is_click"), "total")


@query("msc8_conversation_pages", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 20 OFFSET 10", prelude=False)
def msc8b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").orderBy("conv_id", "turn").offset(10).limit(20).select("conv_id", "turn", "role")


@query("msc13_record_metrics", "SELECT id, processing_time_ms FROM log WHERE id = 5")
def msc13(spark: SparkSession, d: str) -> DataFrame:
    log = Star(spark, d).log().select("id", "processing_time_ms")
    return build.insert_missing(log.where("id <> 5"), log, "id").where("id = 5")


@query("msc14_empty_metrics", "SELECT CAST(0 AS BIGINT) AS n_queries, 0::DOUBLE AS success_rate, 0::DOUBLE AS mean_ms, 0::DOUBLE AS min_ms, 0::DOUBLE AS max_ms, 0::DOUBLE AS mean_confidence")
def msc14(spark: SparkSession, d: str) -> DataFrame:
    return analytics.aggregate_metrics(Star(spark, d).log().where("false"))


# streaming extensions, checked against batch SQL


TUMBLING = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query("ext_stream_tumbling", TUMBLING, prelude=False)
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = stream.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ext_stream_run", TUMBLING, prelude=False)
def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same windows by Structured Streaming over all available input."""
    import uuid

    out = stream.run_available(stream.windowed(stream.read_events(spark, d)), f"tumbling_{uuid.uuid4().hex}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ext_stream_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT min(ts) AS start, user_id, count(*) AS n FROM y GROUP BY user_id, k""", prelude=False)
def session(spark: SparkSession, d: str) -> DataFrame:
    out = stream.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")
