"""Questions over communities and claims: map, reduce, routing."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.runtime import discard, materialize

from . import extraction, generation, rank
from .clients import first_sentence
from .generation import Make, first_context_line
from .numbering import numbered

REDUCE_TASK = "Combine these partial answers into one answer to the question."


def batches(communities: DataFrame, size: int = 10) -> DataFrame:
    """``communities`` with ``batch``: consecutive groups of ``size`` by community."""
    placed = numbered(communities, ["community"], "batch")
    return placed.withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("long"))


def map_reduce(communities: DataFrame, question: str, size: int = 10, generate: Callable[[str], str] = first_sentence) -> tuple[DataFrame, str]:
    """Partial answers of batches of summaries, ranked by BM25, and one final text from the best ten."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text = " ".join(pdf.sort_values("community")["summary"].fillna(""))
        return pd.DataFrame({"batch": [int(pdf["batch"].iloc[0])], "summary": [generate(text)]})

    parts = batches(communities, size).groupBy("batch").applyInPandas(run, "batch long, summary string")
    scored = parts.join(rank.bm25(parts, question, F.col("summary"), ["batch"]), "batch")
    best = rank.top(scored, 10, "batch").collect()
    return scored, generate(" ".join(r["summary"] or "" for r in best))


def reduce_by_rounds(parts: DataFrame, question: str, make: Make = lambda: first_context_line, budget: int = 4000, most_rounds: int = 64, **pace) -> DataFrame:  # noqa: ANN003
    """One row ``answer, n_parts, n_rounds, n_errors`` from partial answers ``place, summary``, by rounds of calls.

    Each round packs answers in the order of ``place`` so that a prompt stays
    under ``budget`` tokens (characters / 4; two answers at least, whatever
    their length), and its replies are the answers of the next, until one is
    left. All of it is tables; a group holds no more than a prompt does. Blank
    answers do not count, a call that fails passes its first answer on. No
    answer at all gives a null answer.
    """
    live = materialize(parts.where(F.trim("summary") != "").select("place", F.col("summary").alias("text"), F.lit(0).alias("failed")), "reduce-parts")
    first = left = live.count()
    rounds = 0
    while left > 1 and rounds < most_rounds:
        longest = live.agg(F.max(F.length("text"))).first()[0] / 4
        fan = max(2, int(budget // max(1.0, longest)))
        packed = numbered(live, ["place"], "r").withColumn("group", F.floor((F.col("r") - 1) / fan).cast("long"))
        listed = packed.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("held"), F.sum("failed").alias("failed"))
        prompts = listed.select(F.col("group").alias("place"), "failed", F.col("held")[0]["text"].alias("first"), generation.parts(REDUCE_TASK, context=F.concat_ws("\n", F.transform("held", lambda x: x["text"])), question=F.lit(question)).alias("prompt"))
        replies = generation.generate(prompts, "prompt", make, **pace)
        nxt = materialize(replies.select("place", F.coalesce("reply", "first").alias("text"), (F.col("failed") + F.col("error").isNotNull().cast("int")).cast("int").alias("failed")), "reduce-parts")
        discard(live)
        live, rounds, left = nxt, rounds + 1, -(-left // fan)
    return live.agg(F.max("text").alias("answer"), F.lit(first).cast("long").alias("n_parts"), F.lit(rounds).alias("n_rounds"), F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("n_errors"))


def claims_for_question(claims: DataFrame, question: str, n: int = 100) -> DataFrame:
    """Claims by BM25 of their description."""
    return rank.top(claims.join(rank.bm25(claims, question, F.col("description"), ["claim_id"]), "claim_id"), n, "claim_id")


def valid_questions(questions: list[str], most: int = 10, longest: int = 1000) -> list[str]:
    """The questions of a batch; an error if there are none, too many, or one is empty or too long."""
    if not 1 <= len(questions) <= most:
        raise ValueError(f"a batch has 1 to {most} questions")
    if any(not q.strip() or len(q) > longest for q in questions):
        raise ValueError(f"a question has 1 to {longest} characters")
    return questions


def route(questions: DataFrame, column: str = "question") -> DataFrame:
    return questions.withColumn("route", extraction.classify_question(F.col(column)))
