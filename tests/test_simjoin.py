"""The similarity join against all pairs: rare, patterned and long names, by both metrics."""

import random

import pytest

from kgspark.operators import resolve, simjoin


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


def by_edits(a, b):
    x, y = a.lower().strip(), b.lower().strip()
    return 1 - edits(x, y) / max(len(x), len(y)) if x or y else 1.0


def made_names(rng):
    out = [f"Supplier#{rng.randrange(200):06d}" for _ in range(40)]
    out += [f"{rng.choice(['building', 'machinery'])} {rng.randrange(100):03d}" for _ in range(40)]
    long_ = ["the united office of statistical and other affairs of region %02d" % i for i in range(12)]
    out += [n[:i] + rng.choice("xyz") + n[i + rng.randrange(2) :] for n in long_ for i in rng.sample(range(60), 3)]
    out += ["".join(rng.choices("abc", k=rng.randrange(1, 8))) for _ in range(30)]
    return out


@pytest.mark.parametrize("threshold, hot, variants", [(0.85, 3, 1000), (0.8, 2, 5), (0.7, 256, 60)])
@pytest.mark.parametrize("metric", ["sequence_ratio", "levenshtein_ratio"])
def test_every_way_of_meeting_is_complete(spark, monkeypatch, threshold, hot, variants, metric):
    real = simjoin.name_pairs
    monkeypatch.setattr(simjoin, "BLOCK", 5)
    monkeypatch.setattr(simjoin, "name_pairs", lambda *a: real(*a, hot=hot, most_variants=variants))
    rows = [(i, n, "x" if i % 5 else "y") for i, n in enumerate(made_names(random.Random(hot)))]
    score = resolve.ratio if metric == "sequence_ratio" else by_edits
    df = spark.createDataFrame(rows, "id int, name string, type string")
    got = sorted((r["id1"], r["id2"]) for r in resolve.duplicate_pairs(df, threshold, getattr(resolve, metric)).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and (a[1], a[0]) < (b[1], b[0]) and score(a[1], b[1]) >= threshold)


@pytest.mark.parametrize("metric", ["sequence_ratio", "levenshtein_ratio"])
def test_best_match_of_every_name(spark, metric):
    rng = random.Random(8)
    names = made_names(rng)
    entities = [(i, n, rng.choice("xy")) for i, n in enumerate(names)]
    wanted = [(i, n[: rng.randrange(2, 40)] if i % 3 else f" {n.upper()} ") for i, n in enumerate(rng.sample(names, 40))] + [(90, None), (91, ""), (92, "nothing like it at all")]
    score = resolve.ratio if metric == "sequence_ratio" else by_edits
    e = spark.createDataFrame([*entities, (900, None, "x")], "id int, name string, type string")
    w = spark.createDataFrame(wanted, "key int, name string")
    got = {r["key"]: (r["id"], r["similarity"]) for r in resolve.best_matches(e, w, 0.8, getattr(resolve, metric)).collect()}
    want = {}
    for key, name in wanted:
        near = [(-score(name, n), i) for i, n, _ in entities if name is not None and score(name, n) > 0.8]
        if near:
            want[key] = (min(near)[1], pytest.approx(-min(near)[0]))
    assert got == want and len(want) > 20


def test_remains_hold_exactly_the_near_pairs(spark):
    """Names of one pattern meet only those that an edit distance allows."""
    names = [f"automobile {i:04d}" for i in range(0, 10_000, 7)]
    df = spark.createDataFrame([("t", n, 3) for n in names], "type string, n string, side int")
    pairs = simjoin.name_pairs(df, 0.85, True, hot=16).collect()
    of = {n: 0 for n in names}
    for r in pairs:
        of[r["n1"]] += 1
        of[r["n2"]] += 1
    assert all(of[a] == sum(edits(a, b) <= 2 for b in names if b != a) for a in names[::200])
    assert all(edits(r["n1"], r["n2"]) <= 2 for r in random.Random(1).sample(pairs, 200))


def test_what_letters_leave_never_goes_through_the_driver(spark):
    """Thousands of remains a name were taken for the few names that they are made of, and broadcast."""
    df = spark.createDataFrame([("t", f"automobile {i:04d}", 1 + i % 3) for i in range(600)], "type string, n string, side int")
    pairs = simjoin.name_pairs(df, 0.85, True, hot=16)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan and "BroadcastNestedLoop" not in plan


def test_only_lengths_that_exist_are_planned():
    assert simjoin._plan(18, 0.6, False, 1000, frozenset({100})) == ([], [])
    assert simjoin._plan(18, 0.85, False, 1000, frozenset({16}))[0] == [3]


def test_equal_letters_leave_a_text_once():
    left = [text for text, _, _ in simjoin.remains("supplier#000000012", [2], False)]
    assert len(left) == len(set(left)) < 153
    assert len(list(simjoin.remains("supplier#000000012", [2], True))) == 153


def test_best_matches_end_at_the_first_bar_that_serves(spark, monkeypatch):
    seen, real = [], simjoin.name_pairs
    monkeypatch.setattr(simjoin, "name_pairs", lambda names, bar, *a: (seen.append(bar), real(names, bar, *a))[1])
    e = spark.createDataFrame([(i, f"supplier#{i:09d}", "x") for i in range(30)], "id int, name string, type string")
    w = spark.createDataFrame([(i, f"suplier#{i:09d}") for i in range(30)], "key int, name string")
    assert {(r["key"], r["id"]) for r in resolve.best_matches(e, w, 0.6).collect()} == {(i, i) for i in range(30)}
    assert seen == [0.9]


def test_one_value_is_numbered_in_many_partitions(spark):
    from pyspark.sql import functions as F

    from kgspark.operators import numbering

    rows = spark.range(40_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).alias("v"))
    out = numbering.numbered(rows, ["v"])
    assert sorted(r["r"] for r in out.select("r").collect()) == list(range(1, 40_001))
    assert out.where("v >= 0").agg(F.min("r")).first()[0] == 39_601
    files = out.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert max(r["count"] for r in files) < 20_000


def test_no_broadcast_hint_on_tables_that_grow(spark):
    from kgspark.operators import reason

    edges = spark.createDataFrame([("a", "b", "k", 1.0)], "src string, dst string, rel_key string, confidence double")
    front = spark.createDataFrame([("a",)], "id string")
    plan = reason.relation_statistics(edges, front)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in plan and "UnresolvedHint" not in plan


def test_a_way_that_no_name_takes_is_no_query(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "_by_blocks", lambda *a: pytest.fail("no name is too long"))
    names = spark.range(60).selectExpr("'x' AS type", "concat('Supplier#', lpad(cast(id * 7 as string), 9, '0')) AS n", "3 AS side")
    met = simjoin.name_pairs(names, 0.85, True, hot=8)
    assert met._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2  # before: 3
    rows = [r["n"] for r in names.collect()]
    assert sorted((r["n1"], r["n2"]) for r in met.collect()) == sorted((a, b) for a in rows for b in rows if a < b and by_edits(a, b) >= 0.85)


def test_what_is_made_of_pairs_is_planned_apart_from_the_search_for_them(spark):
    df = spark.createDataFrame([(i, f"Supplier#{i:09d}", "x") for i in range(40)], "id int, name string, type string")
    for out in (resolve.duplicate_pairs(df, 0.85, resolve.levenshtein_ratio), resolve.similar_to_all(df, df.selectExpr("id AS key", "name"), by_type=False)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "names-met" in plan and "names-keyed" not in plan


def test_entities_are_read_once(spark):
    from kgspark.operators import beam, reason, scoring

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    kinds = "id string, name string, type string, description string, mention_count long"
    rows = [(f"e{i}", f"thing {i:03d}", "a", "", 1) for i in range(20)]
    entities = spark.createDataFrame(rows, kinds).mapInArrow(seen, kinds)
    asked = spark.createDataFrame([(1, "thng 004", None), (2, "zz", None)], "question_id long, question string, document_ids array<string>")
    edges = spark.createDataFrame([("e0", "e1", "r", 1.0), ("e1", "e2", "r", 1.0)], "src string, dst string, rel_key string, confidence double")
    starts = spark.createDataFrame([(1, "e0")], "question_id long, id string")
    runs = (
        lambda: beam.fallback(asked, entities),
        lambda: resolve.duplicate_pairs(entities, 0.85, resolve.levenshtein_ratio),
        lambda: resolve.best_matches(entities, asked.selectExpr("question_id AS key", "question AS name")),
        lambda: beam.reason_all(asked, starts, entities, edges, reason.Config(search_depth=2), scorer=scoring.constant).triplets,
    )
    for run in runs:
        read.value = 0
        assert run().collect()
        assert read.value == len(rows)


@pytest.mark.parametrize("metric", ["sequence_ratio", "levenshtein_ratio"])
@pytest.mark.parametrize("most", [0, 1 << 20])
def test_blocks_hold_every_pair(spark, monkeypatch, metric, most):
    """Names in several entries and blocks, light and heavy, with repeated, null and empty ones, and letters whose lower case is longer."""
    from kgspark.operators import blockjoin

    monkeypatch.setattr(resolve, "MOST_BLOCKED", most)
    for name, value in (("CHUNK", 4), ("LIGHT", 2), ("ENTRIES", 6), ("CELLS", 16), ("STEP", 7), ("COLUMNS", 3)):
        monkeypatch.setattr(blockjoin, name, value)
    rng = random.Random(4)
    names = [*made_names(rng)[::2], "", " ", "  Supplier#000007", "SUPPLIER#000007", "İstanbul", "İstanbol", "x" * 70, "x" * 64, "x" * 60 + "y" * 4]
    rows = [(i, n, "x" if i % 4 else "y") for i, n in enumerate([*names, *["red bolt"] * 11, *["red bolts"] * 6, *["RED bolt"] * 3, None])]
    score = resolve.ratio if metric == "sequence_ratio" else by_edits
    df = spark.createDataFrame(rows, "id int, name string, type string")
    got = sorted((r["id1"], r["id2"], round(r["similarity"], 9)) for r in resolve.duplicate_pairs(df, 0.8, getattr(resolve, metric)).collect())
    named = [r for r in rows if r[1] is not None]
    if metric == "levenshtein_ratio":  # lower case of the JVM is that of Python but for the length of this letter
        named = [r for r in named if "İ" not in r[1]]
        got = [g for g in got if "İ" not in rows[g[0]][1] + rows[g[1]][1]]
    assert got == sorted((a[0], b[0], round(score(a[1], b[1]), 9)) for a in named for b in named if a[2] == b[2] and (a[1], a[0]) < (b[1], b[0]) and score(a[1], b[1]) >= 0.8)


def test_matching_blocks_are_those_of_difflib():
    import difflib

    from kgspark.operators import blockjoin

    rng = random.Random(1)
    for letters, x, y in (("ab", 8, 8), ("abc", 12, 9), ("0123456789", 18, 18), ("ab", 64, 60)):
        a, b = (["".join(rng.choices(letters, k=k)) for _ in range(200)] for k in (x, y))
        got = blockjoin.matches(blockjoin._codes(a, x), blockjoin._codes(b, y))
        assert got.tolist() == [sum(m.size for m in difflib.SequenceMatcher(None, u, v).get_matching_blocks()) for u, v in zip(a, b, strict=True)]


def test_a_pair_of_names_of_one_pattern_is_no_row_before_its_metric(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "name_pairs", lambda *a: pytest.fail("names of one pattern met one by one"))
    df = spark.createDataFrame([(i, f"Supplier#{i:09d}", "x") for i in range(40)], "id int, name string, type string")
    assert resolve.duplicate_pairs(df, 0.85).count() == sum(resolve.ratio(f"Supplier#{i:09d}", f"Supplier#{j:09d}") >= 0.85 for j in range(40) for i in range(j))
