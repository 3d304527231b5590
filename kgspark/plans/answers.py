"""Queries of the steps that ask a generator, with deterministic ones, and of progress, contexts and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import chunking, clients, generation, graph, resolve
from kgspark.runtime import table
from kgspark.streaming import progress

from .base import STAR_SQL, Registry, Star

query = Registry(STAR_SQL)
QUERIES, SQL = query.queries, query.sql
#: No least spacing between the calls of a generator that answers at once.
AT_ONCE = {"spacing": 0.0, "wait": 0.0}


def _nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("msc1_generate", "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 5 <> 3 THEN n_name || '.' END AS reply, CASE WHEN n_nationkey % 5 = 3 THEN 'no prompt' END AS error FROM nation", prelude=False)
def msc1(spark: SparkSession, d: str) -> DataFrame:
    asked = _nations(spark, d).select("k", F.when(F.col("k") % 5 != 3, F.concat(F.lit("  "), "nation", F.lit(". And more."))).alias("prompt"))
    return generation.generate(asked, **AT_ONCE | {"tries": 1}).select("k", "reply", "error")


@query("msc2_answers", """SELECT 'where is ' || n_name AS question, n_name || ' lies in ' || r_name || '.' || CASE WHEN n_nationkey % 2 = 0 THEN ' [' || r_name || ', atlas]' ELSE '' END AS answer,
CASE WHEN n_nationkey % 2 = 0 THEN [r_name, 'atlas'] ELSE [] END AS citations, 'success' AS status FROM nation JOIN region ON n_regionkey = r_regionkey""", prelude=False)
def msc2(spark: SparkSession, d: str) -> DataFrame:
    cited = F.when(F.col("k") % 2 == 0, F.array("region", F.lit("atlas")))
    asked = _nations(spark, d).select(F.concat(F.lit("where is "), "nation").alias("question"), F.concat("nation", F.lit(" lies in "), "region", F.lit(". It is large.")).alias("context"), cited.alias("citations"))
    return generation.answers(asked, **AT_ONCE)


@query("msc3_member_summaries", "SELECT CAST(n_regionkey AS BIGINT) AS community, string_agg(n_name, ', ' ORDER BY n_name) || '.' AS summary, 'success' AS status FROM nation GROUP BY n_regionkey", prelude=False)
def msc3(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("community")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return generation.community_summaries(n.withColumns({"relations": F.lit("They trade. Often."), "sample_text": F.lit(None).cast("string")}), lambda: lambda asked: clients.first_sentence(asked.partition("Context:\n")[2].replace(".\n", ". ")), **AT_ONCE)


def _replies() -> clients.Generator:
    """JSON in a fence, plain text longer than 200 characters, or a failure, by the nation's number."""

    def reply(asked: str) -> str:
        name = asked.rsplit(" ", 1)[1]
        kind = int(name.split("_")[1]) % 3
        if kind == 2:
            raise ConnectionError("no answer")
        return f'```json\n{{"summary": "about {name}", "themes": ["trade", "{name}"], "focus_area": "region"}}\n```' if kind == 0 else name + "x" * 300

    return reply


@query("msc4_community_reports", """SELECT CAST(n_nationkey AS BIGINT) AS community, CASE n_nationkey % 3 WHEN 0 THEN 'about ' || n_name WHEN 1 THEN left(n_name || repeat('x', 300), 200) ELSE 'Summary generation failed' END AS summary,
CASE n_nationkey % 3 WHEN 0 THEN ['trade', n_name] ELSE [] END AS themes, CASE n_nationkey % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'Unknown' ELSE 'Error' END AS focus_area FROM nation""", prelude=False)
def msc4(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d).select(F.col("k").alias("community"), F.concat(F.lit("members of "), "nation").alias("text"))
    return generation.community_reports(n, _replies, **AT_ONCE | {"tries": 1})


def _twins(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pairs A, B of a nation under two names: equal but for case, or not."""
    n = _nations(spark, d)
    one = n.select(F.concat(F.lit("A"), F.col("k").cast("string")).alias("id"), F.col("nation").alias("name"))
    two = n.select(F.concat(F.lit("B"), F.col("k").cast("string")).alias("id"), F.when(F.col("k") % 3 == 0, F.lower("nation")).otherwise(F.concat(F.lit("isle of "), "nation")).alias("name"))
    both = one.union(two).withColumns({"type": F.lit("NATION"), "description": F.lit(None).cast("string"), "mention_count": F.lit(2).cast("long")})
    return n.select(F.concat(F.lit("A"), F.col("k").cast("string")).alias("id1"), F.concat(F.lit("B"), F.col("k").cast("string")).alias("id2"), F.when(F.col("k") % 5 == 0, 0.96).otherwise(0.9).alias("similarity"), F.lit(3).alias("mentions1"), F.lit(2).alias("mentions2")), both


@query("er5_same_entity", """SELECT 'A' || n_nationkey AS id1, 'B' || n_nationkey AS id2, 'success' AS status, n_nationkey % 3 = 0 AS are_same, CASE WHEN n_nationkey % 3 = 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS confidence,
CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'isle of ' || n_name END AS suggested_canonical_name FROM nation""", prelude=False)
def er5(spark: SparkSession, d: str) -> DataFrame:
    pairs, entities = _twins(spark, d)
    return generation.same_entity(pairs, entities, **AT_ONCE).drop("reasoning")


@query("er5_resolved_pairs", "SELECT 'A' || n_nationkey AS id1, 'B' || n_nationkey AS id2, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 THEN 'merge' ELSE 'keep' END AS decision FROM nation", prelude=False)
def er5b(spark: SparkSession, d: str) -> DataFrame:
    pairs, entities = _twins(spark, d)
    decided = resolve.decide(pairs)
    verdicts = generation.same_entity(decided.where("decision = 'ask'"), entities, **AT_ONCE)
    return generation.resolve_asked(decided, verdicts).select("id1", "id2", "decision")


@query("er1_similarity", "SELECT * FROM (VALUES (' Acme', 'acme ', 1.0::DOUBLE), ('diet', 'tide', 0.5), ('tide', 'diet', 0.25), ('', '\t', 1.0), ('abcd', 'bcde', 0.75)) t(a, b, similarity)".replace("\t", "' || chr(9) || '"), prelude=False)
def er1(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([(" Acme", "acme "), ("diet", "tide"), ("tide", "diet"), ("", "\t"), ("abcd", "bcde")], "a string, b string")
    return pairs.withColumn("similarity", resolve.sequence_ratio(F.col("a"), F.col("b")))


@query("ext14_pacing", "SELECT * FROM (VALUES (0, 'reply', 1, 0.0::DOUBLE), (1, 'reply', 2, 1.0), (2, 'reply', 3, 3.0), (3, 'error', 3, 3.0)) t(failures, outcome, calls, waited)", prelude=False)
def ext14(spark: SparkSession, d: str) -> DataFrame:
    """Calls and waits of a generator that fails so many times: three tries, doubling waits."""
    rows = []
    for failures in range(4):
        waits, calls = [], []

        def call(asked: str, failures: int = failures, calls: list = calls) -> str:
            calls.append(asked)
            if len(calls) <= failures:
                raise ConnectionError
            return "reply"

        try:
            outcome = clients.paced(call, spacing=0.0, sleep=waits.append)("q")
        except ConnectionError:
            outcome = "error"
        rows.append((failures, outcome, len(calls), float(sum(waits))))
    return spark.createDataFrame(rows, "failures int, outcome string, calls int, waited double")


@query("inc6_milestones", "SELECT * FROM (VALUES (0, 0, 'started'), (1, 0, 'read'), (2, 20, 'extract'), (3, 90, 'store'), (4, 100, 'completed')) t(step, percent, stage)", prelude=False)
def inc6(spark: SparkSession, d: str) -> DataFrame:
    told: list[tuple[int, str]] = []
    docs = Star(spark, d).documents()
    progress.run_stages([("read", 2, docs.count), ("extract", 7, lambda: docs.select("name").distinct().count()), ("store", 1, lambda: None)], lambda percent, stage: told.append((percent, stage)))
    return spark.createDataFrame([(i, *t) for i, t in enumerate(told)], "step int, percent int, stage string")


@query("gr5_same_community", "SELECT 'same_community' AS kind, count(*) AS n_edges, CAST(NULL AS INTEGER) AS hops, CAST(NULL AS VARCHAR[]) AS path FROM rel WHERE (src = 'S1' AND dst = 'P1') OR (src = 'P1' AND dst = 'S1')")
def gr5b(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    both = spark.createDataFrame([("S1", 4), ("P1", 4)], "id string, community int")
    return graph.path_between(g.relationships(), both, "S1", "P1")


@query("gr7_entity_texts", "SELECT text_unit_id, start_char, text FROM m JOIN tu ON tu.id = text_unit_id WHERE entity_id = 'S1' ORDER BY start_char, text_unit_id LIMIT 10")
def gr7b(spark: SparkSession, d: str) -> DataFrame:
    g = Star(spark, d)
    return graph.context_texts(g.mentions(), g.text_units(), spark.createDataFrame([("S1",)], "id string"))


def _ranks() -> object:
    import public_tokenizers

    return chunking.rank_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("txt1_rank_tokens")
def txt1b(spark: SparkSession, d: str) -> DataFrame:
    """Byte-level BPE counts of whole texts."""
    return chunking.count_tokens(table(spark, d, "documents"), _ranks())


@query("txt4_rank_chunks")
def txt4b(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose sizes are byte-level BPE counts."""
    return chunking.chunk_documents(table(spark, d, "documents"), make=_ranks())
