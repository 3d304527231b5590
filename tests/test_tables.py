"""Table functions from SQL against the DataFrame forms, and reduction by rounds."""

import re

import pytest

from kgspark.functions import tables
from kgspark.operators import chunking, globalqa, parse

REPLIES = [
    ("1", '("entity"|||Acme|||org|||A firm\nof two lines)\n("relationship"|||Acme|||Bolt|||makes|||7)\n(bad|||x)\n<COMPLETE>\n("entity"|||Late|||t|||d)'),
    ("2", None),
    ("3", ""),
    ("4", "```\n(entity|||B|||t|||d\n```"),
]
CLAIMS = [("1", "(A<|>B<|>t<|>true<|>NONE<|>2024<|>d<|>s)\n##\n(x<|>y)\n##\nnoise ( C <|>D<|>t<|>f<|>none<|>1<|>two\nlines<|>s \n<|COMPLETE|>(E<|>)"), ("2", None), ("3", "")]


def test_table_functions_equal_the_dataframe_forms(spark):
    tables.register(spark)
    replies = spark.createDataFrame(REPLIES, "chunk_id string, reply string")
    got = spark.sql("SELECT r.chunk_id, g.* FROM {r} r, LATERAL parse_graph_tuples(r.reply) g", r=replies)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, parse.parse_graph_replies(replies).collect())) and got.count() == 3
    claims = spark.createDataFrame(CLAIMS, "chunk_id string, reply string")
    got = spark.sql("SELECT r.chunk_id, c.* FROM {r} r, LATERAL parse_claims(r.reply) c", r=claims)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, parse.parse_claims(claims).collect())) and got.count() == 2
    docs = spark.createDataFrame([(1, "One two three. Four five six.\n\nSeven eight nine."), (2, None), (3, "")], "doc_id int, text string")
    got = spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL chunk_text(d.text, size => 6, overlap => 2, least => 1) c", d=docs).collect()
    want = chunking.chunk_documents(docs, settings=chunking.ChunkSettings(size=6, overlap=2, least=1)).collect()
    assert sorted((str(r["doc_id"]), r["ordinal"], r["text"], r["start_char"]) for r in got) == sorted((r["document_id"], r["ordinal"], r["text"], r["start_char"]) for r in want)


def test_reduction_keeps_every_part_and_survives_errors(spark):
    def adding():
        return lambda asked: str(sum(map(int, re.findall(r"\d+", asked))))

    parts = spark.range(1, 1001).selectExpr("id AS place", "cast(id AS string) AS summary")
    row = globalqa.reduce_by_rounds(parts, "sum", adding, budget=20, spacing=0.0).first()
    assert row["answer"] == "500500" and row["n_parts"] == 1000 and row["n_errors"] == 0 and 3 <= row["n_rounds"] <= 9

    def failing():
        def run(asked):
            raise OSError("down")

        return run

    row = globalqa.reduce_by_rounds(parts.where("id <= 4"), "sum", failing, budget=1000, spacing=0.0, tries=1).first()
    assert (row["answer"], row["n_errors"], row["n_rounds"]) == ("1", 1, 1)
    none = globalqa.reduce_by_rounds(parts.where("false"), "sum", adding).first()
    assert (none["answer"], none["n_parts"], none["n_rounds"]) == (None, 0, 0)


@pytest.mark.parametrize("name", sorted(tables.FUNCTIONS))
def test_functions_are_known_to_sql(spark, name):
    tables.register(spark)
    assert spark.sql(f"SELECT * FROM {name}(cast(null AS string))").count() == 0
