"""Cache entries from a stream, out of order, against the table form and the live filter."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kgspark.streaming import cache

START = datetime(2024, 1, 1)
SCHEMA = "key string, op string, value string, ts timestamp"


def at(s):
    return START + timedelta(seconds=s)


def test_stream_equals_the_table_form(spark, tmp_path):
    rng = random.Random(2)
    events = [(rng.choice("abc"), rng.choice(["put", "put", "write"]), rng.choice(["x", "y", None]), at(rng.randrange(4000))) for _ in range(150)]
    events += [("a", "other", "x", at(5)), (None, "put", "x", at(5)), ("b", "put", "x", None), events[0]]
    spark.createDataFrame(events, SCHEMA).createOrReplaceTempView("cache_events")
    want = cache.entries(spark.table("cache_events"), 300)
    known = sorted((e for e in events if e[3] is not None), key=lambda e: e[3])
    (tmp_path / "in").mkdir()
    # batches in time order, but rows inside the delay are dealt to a later batch
    batches = [[] for _ in range(8)]
    for e in known:
        k = int((e[3] - START).total_seconds()) // 600
        batches[k + (rng.random() < 0.3)].append(e)
    batches.append([("z", "write", None, at(100_000))])
    batches.append([("z", "write", None, at(200_000))])
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        cache.entry_stream(stream, 300, "40 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(cache.RESULT).parquet(out)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 50
    assert {r["why"] for r in got.collect()} == {"expired", "replaced", "purged"}
    for s in (0, 700, 1500, 3999):
        live = got.where((F.col("stored_at") <= F.lit(at(s))) & (F.col("ended_at") > F.lit(at(s)))).select("key").collect()
        last = {}
        for key, op, value, ts in sorted((e for e in known if e[0] and e[1] in ("put", "write") and e[3] <= at(s)), key=lambda e: (e[3], e[1], e[2] is not None, e[2] or "")):
            last[key] = (op, ts)
        assert sorted(r["key"] for r in live) == sorted(k for k, (op, ts) in last.items() if op == "put" and ts + timedelta(seconds=300) > at(s))


def test_appended_rows_of_a_stream_go_to_files(spark, tmp_path):
    """They were held in the driver's memory; an empty result is an empty table."""
    from kgspark.streaming import events

    spark.createDataFrame([(k, "put", "x", at(600 * k)) for k in range(9)], "key int, op string, value string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA.replace("key string", "key int")).parquet(str(tmp_path / "in"))
    rows = events.run_available(cache.entry_stream(stream, 300), "kept")
    assert {r["key"] for r in rows.collect()} == {str(k) for k in range(7)} and len(rows.inputFiles()) > 0
    assert events.run_available(cache.entry_stream(stream.where("key < 0"), 300), "none").count() == 0
