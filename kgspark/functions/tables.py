"""Table functions for SQL: chunks of a text, tuples of a reply. Use them by lateral join.

    SELECT d.id, c.* FROM documents d, LATERAL chunk_text(d.text) c
    SELECT r.id, g.* FROM replies r, LATERAL parse_graph_tuples(r.reply) g
    SELECT r.id, c.* FROM replies r, LATERAL parse_claims(r.reply) c
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from kgspark.operators import chunking, parse


@udtf(returnType="ordinal int, text string, start_char int, end_char int")
class ChunkText:
    """The chunks of ``chunking.chunks``; sizes in tokens by characters / 4. Null text has none, null sizes are the defaults."""

    def eval(self, text: str, size: int = None, overlap: int = None, least: int = None) -> Iterator[tuple]:  # noqa: RUF013
        given = {k: v for k, v in (("size", size), ("overlap", overlap), ("least", least)) if v is not None}
        for k, chunk in enumerate(chunking.chunks(text or "", chunking.ChunkSettings(**given))):
            yield k, *chunk


@udtf(returnType=f"seq int, {parse.RECORD}")
class ParseGraphTuples:
    """The records of ``parse.graph_records`` in the order of the reply; a null reply has none."""

    def eval(self, reply: str) -> Iterator[tuple]:
        for k, record in enumerate(parse.graph_records(reply or "")):
            yield k, *record


@udtf(returnType=f"seq int, {parse.CLAIM}")
class ParseClaims:
    """The records of ``parse.claim_records`` in the order of the reply; a null reply has none."""

    def eval(self, reply: str) -> Iterator[tuple]:
        yield from parse.claim_records(reply or "")


FUNCTIONS = {"chunk_text": ChunkText, "parse_graph_tuples": ParseGraphTuples, "parse_claims": ParseClaims}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
