"""Rules on small literal inputs, with the edge cases that tables seldom hold."""

import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import analytics, build, chunking, clients, community, extraction, globalqa, graph, incremental, parse, rank, reason, resolve
from kgspark.operators.components import connected_components


def values(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_chunks_of_short_and_exact_texts():
    assert chunking.chunks("") == []
    assert chunking.chunks("x" * 399) == []
    assert chunking.chunks("x" * 4000) == [("x" * 4000, 0, 4000)]


def test_chunks_overlap_and_lost_start():
    first, second = "a" * 3600, "b" * 2000
    out = chunking.chunks(f"{first}\n\n{second}")
    assert out[0] == (first, 0, 3600)
    assert out[1][0].startswith("a" * 1200) and out[1][0].endswith(second)
    small = chunking.chunks("s" * 100 + "\n\n" + "b" * 3999)
    assert [c[0][0] for c in small] == ["b"]


def test_chunk_of_one_long_sentence():
    text = ("word " * 1000 + "end. ") * 2
    assert all(len(c) >= 4000 for c, _, _ in chunking.chunks(text.strip()))


def test_graph_records_edges():
    reply = '```\n("entity"|||A|||person|||first\nline two)\n("entity"|||short)\n("relationship"|||A|||B|||d|||15\n("relationship"|||A|||B|||d|||abc)\n<COMPLETE>("entity"|||late|||x|||y)'
    got = list(parse.graph_records(reply))
    assert [g[0] for g in got] == ["entity", "relationship", "relationship"]
    assert got[0][4] == "first line two" and got[0][2] == "PERSON"
    assert got[1][5] == 1.0 and got[2][6] == 5.0


def test_claims_edges(spark):
    reply = "# heading ##\n(A<|>NONE<|>t<|>true<|>NONE<|>2020<|>d<|>s\n##(only<|>seven<|>f<|>f<|>f<|>f<|>f)<|COMPLETE|>(x<|>y)"
    rows = parse.parse_claims(spark.createDataFrame([("c", reply), ("n", None)], "chunk_id string, reply string")).collect()
    assert [(r["subject"], r["start_date"], r["end_date"], r["status"], r["source_text"]) for r in rows] == [("A", None, "2020", "TRUE", "s")]


def test_ids_ignore_case(spark):
    df = spark.createDataFrame([("Acme",), ("ACME",), ("acme ",)], "name string")
    assert df.select(T.entity_id(F.col("name"), F.lit("Org")).alias("i")).distinct().count() == 1
    seq = F.lit(0)
    found = df.withColumns({"type": F.lit("Org"), "description": F.lit("d"), "confidence": F.lit(0.5), "seq": seq})
    assert build.upsert_entities(None, found).count() == 3


def test_upsert_keeps_first_description(spark):
    found = spark.createDataFrame([("a", "t", "one", 0.5, 1), ("a", "t", "two", 0.9, 2)], "name string, type string, description string, confidence double, seq int")
    once = build.upsert_entities(None, found)
    twice = build.upsert_entities(once, found)
    assert values(once, "description", "confidence", "mention_count") == [("one", 0.9, 2)]
    assert values(twice, "description", "mention_count") == [("one", 4)]


def test_similarity_depends_on_order():
    assert resolve.ratio("tide", "diet") == 0.25 and resolve.ratio("diet", "tide") == 0.5
    assert resolve.ratio(" Acme", "acme ") == 1.0 and resolve.ratio(None, "x") is None


def test_duplicate_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 9))).strip() or "a" for _ in range(60)]
    rows = [(i, n, rng.choice("xy")) for i, n in enumerate(names)]
    got = values(resolve.duplicate_pairs(spark.createDataFrame(rows, "id int, name string, type string"), 0.7), "id1", "id2")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and (a[1], a[0]) < (b[1], b[0]) and resolve.ratio(a[1], b[1]) >= 0.7)
    assert got == want


@pytest.mark.parametrize("threshold", [0.5, 0.85, 0.9])
@pytest.mark.parametrize("metric, plain", [("sequence_ratio", resolve.ratio), ("levenshtein_ratio", None)])
def test_duplicate_pairs_are_complete(spark, threshold, metric, plain):
    """Empty, equal and tab-padded names, all short lengths, and long names with few edits."""
    rng = random.Random(14)
    names = ["", " ", "\t", None, "abcdefgh", "\t\t\t\t\tabcdefgh", "Abcdefgh\u2003", "a", "A", "ab", "axb", "abc", "x" * 250, "x" * 249 + "y"]
    names += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    for _ in range(25):
        base = [rng.choice("abcdefghij ") for _ in range(rng.randrange(8, 25))]
        names.append("".join(base))
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(base))
            base[i : i + rng.randrange(2)] = [rng.choice("abcdefghij")] * rng.randrange(3)
        names.append("".join(base))
    rows = [(i, n, rng.choice("xy") if i else None) for i, n in enumerate(names)]
    got = values(resolve.duplicate_pairs(spark.createDataFrame(rows, "id int, name string, type string"), threshold, getattr(resolve, metric)), "id1", "id2")

    def edits(a, b):
        x, y = a.lower().strip(), b.lower().strip()
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return 1 - row[-1] / max(len(x), len(y)) if x or y else 1.0

    score = plain or edits
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    assert got == sorted((a[0], b[0]) for a in known for b in known if a[2] == b[2] and (a[1], a[0]) < (b[1], b[0]) and score(a[1], b[1]) >= threshold)


def test_merge_chain_loop_and_alias(spark):
    e = spark.createDataFrame([("1", "A", "t", "d", 0.5, 3, ["B"]), ("2", "B", "t", None, 0.7, 2, None), ("3", "C", "t", None, 0.1, None, None), ("4", "D", "t", None, 0.1, 1, None)], "id string, name string, type string, description string, confidence double, mention_count long, aliases array<string>")
    mapping = resolve.merge_map(spark.createDataFrame([("1", "2"), ("2", "3")], "id1 string, id2 string"), e)
    assert values(mapping) == [("1", "1"), ("2", "1"), ("3", "1")]
    merged = {r["id"]: r for r in resolve.merge_entities(e, mapping).collect()}
    assert merged["1"]["mention_count"] == 6 and merged["1"]["aliases"] == ["B", "C"] and merged["4"]["aliases"] == []
    edges = spark.createDataFrame([("1", "2", "r", 0.5), ("2", "4", "r", 0.5), ("3", "4", "r", 0.9)], "src string, dst string, rel_label string, confidence double")
    assert values(resolve.merge_edges(edges, mapping), "src", "dst", "confidence") == [("1", "4", 0.9)]
    assert values(resolve.rename_conflicts(e, spark.createDataFrame([("1", "D"), ("2", "Z")], "id string, name string")), "id", "conflict") == [("1", True), ("2", False)]


def test_claim_linking_cascade(spark):
    e = spark.createDataFrame([("1", "THỬ NGHIỆM"), ("2", "Sandbox"), ("3", "River Bank Trust")], "id string, name string")
    wanted = [("a", "THỬ NGHIỆM (REGULATORY SANDBOX)"), ("b", "sandbox"), ("c", "the River Bank Trust office"), ("d", "nothing"), ("e", None), ("f", "Sandbox")]
    got = values(build.link_names(spark.createDataFrame(wanted, "claim_id string, subject string"), e, "subject"))
    assert got == [("a", "1", 3), ("b", "2", 2), ("c", "3", 4), ("f", "2", 1)]


def test_claim_linking_finds_names_inside_words(spark):
    e = spark.createDataFrame([("1", "Bankers United"), ("2", "The Megabank"), ("3", "X(Y)Z corp"), ("4", "q"), ("5", "(only)")], "id string, name string")
    wanted = [("a", "BANK"), ("b", "megaban"), ("c", "an XYZ corporation"), ("d", "faq"), ("e", "(gone)"), ("f", "kw"), ("g", "Bankers")]
    got = values(build.link_names(spark.createDataFrame(wanted, "claim_id string, subject string"), e, "subject"))
    assert got == [("a", "1", 3), ("b", "2", 4), ("c", "3", 4), ("d", "4", 4), ("g", "1", 3)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("abc(", max_size=5), max_size=12), st.lists(st.text("abc(", max_size=8), max_size=12))
def test_containments_equal_brute_force(spark, needles, hay):
    n = spark.createDataFrame([(x,) for x in set(needles)], "needle string")
    h = spark.createDataFrame([(x,) for x in set(hay)], "hay string")
    assert values(build.containments(n, h)) == sorted((x, y) for x in set(needles) for y in set(hay) if x and x in y)


def test_numbered_is_consecutive(spark):
    from kgspark.operators.numbering import numbered

    rows = [(i % 7 if i % 11 else None, i % 5) for i in range(300)]
    out = numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"]).collect()
    assert sorted(r["r"] for r in out) == list(range(1, 301))
    assert [(r["a"], r["b"]) for r in sorted(out, key=lambda r: r["r"])] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_no_window_without_partition(spark, sf):
    """No registered query of the log and the communities sorts a whole table in one task."""
    from kgspark.plans import catalog

    queries = catalog.queries()
    for name in ("ana3_p95", "ana5_trend", "ord9_halves", "glb1_batches"):
        plan = queries[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan or "windowspecdefinition(part_" in plan or "windowspecdefinition(o_custkey" in plan, name


def test_chunks_of_repeated_passages_and_without_overlap():
    paragraph = "\n\n".join(" ".join([w] * 30) for w in ("one", "two", "six"))
    text = "\n\n".join([paragraph] * 4)
    s = chunking.ChunkSettings(size=60, overlap=0, least=5)
    out = chunking.chunks(text, s)
    assert all(text[a:b] == c for c, a, b in out)
    assert all(b1 <= a2 for (_, _, b1), (_, a2, _) in zip(out, out[1:], strict=False))
    lapped = chunking.chunks(text, chunking.ChunkSettings(size=60, overlap=10, least=5))
    assert all(a is None or text[a:b] == c for c, a, b in lapped)
    assert [a for _, a, _ in lapped if a is not None] == sorted({a for _, a, _ in lapped if a is not None})


def test_chunk_sizes_by_ranks():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    count = chunking.rank_counter(path, public_tokenizers.PATTERN)()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = "The quick brown fox jumps over the lazy dog; naïve façade, 東京. "
    assert count(words) == len(library.encode_ordinary(words)) != chunking.tokens(words)
    out = chunking.chunks("\n\n".join(words * k for k in range(1, 9)), chunking.ChunkSettings(size=120, overlap=20, least=10), count)
    assert len(out) > 2 and all(count(c) <= 120 + 20 + 4 for c, _, _ in out)


def test_generator_steps_keep_errors_in_their_rows(spark):
    from kgspark.operators import generation

    def make():
        def reply(asked):
            if "Name: bad" in asked:
                raise ValueError("no")
            return "not json" if "Name: text" in asked else '{"are_same": true}'

        return reply

    e = spark.createDataFrame([("1", "a", "t", None, None), ("2", "bad", "t", "d", 1), ("3", "text", "t", "d", 1), ("4", "b", "t", "d", 1)], "id string, name string, type string, description string, mention_count int")
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("1", "4")], "id1 string, id2 string")
    got = {r["id2"]: r for r in generation.same_entity(pairs, e, make, spacing=0.0, wait=0.0).collect()}
    assert [got[k]["status"] for k in "234"] == ["error", "error", "success"]
    assert (got["4"]["are_same"], got["4"]["confidence"], got["4"]["suggested_canonical_name"]) == (True, 0.0, "a") and not got["2"]["are_same"]
    assert generation.generate(e.where("false").select("id", "name"), "name").count() == 0


def test_milestones_and_stream_listener(spark, sf):
    import time

    from kgspark.streaming import events, progress

    told = []
    with pytest.raises(RuntimeError):
        progress.run_stages([("a", 1, lambda: 1), ("b", 1, lambda: (_ for _ in ()).throw(RuntimeError("x")))], lambda p, s: told.append((p, s)))
    assert told == [(0, "started"), (0, "a"), (50, "b"), (0, "failed: x")]
    heard = []
    listener = progress.watch(spark, lambda name, state, rows: heard.append((state, rows)))
    try:
        events.run_available(events.windowed(events.read_events(spark, sf)), "watched", "complete").count()
        for _ in range(50):
            if heard and heard[-1][0] == "completed":
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert heard[0] == ("started", 0) and heard[-1][0] == "completed" and heard[-1][1] > 0


def test_paths_and_contexts(spark):
    rows = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y")]
    edges = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "src string, dst string, rel_key string, confidence double")
    assert graph.shortest_path(edges, "a", "e", 3).first()["path"] == ["a", "c", "d", "e"]
    assert graph.shortest_path(edges, "a", "e", 2).count() == 0
    assert graph.shortest_path(edges, "a", "x", 4).count() == 0
    assert graph.shortest_path(edges, "a", "a", 2).first()["hops"] == 0
    centre = spark.createDataFrame([("a",)], "id string")
    assert ("a", 2, "k") in values(graph.context(edges, centre))
    assert values(graph.ego(edges, centre)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components_equal_union_find(spark, pairs):
    root = list(range(13))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = sorted((x, find(x)) for x in {n for p in pairs if p[0] != p[1] for n in p})
    assert values(connected_components(spark.createDataFrame(pairs, "a int, b int"))) == want


def test_leiden_finds_cliques_and_keeps_components(spark):
    groups = [[f"{g}{i}" for i in range(5)] for g in "abc"]
    rows = [(x, y) for g in groups for x in g for y in g if x < y] + [("a0", "b0")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    found = community.detect_communities(edges).where("level = 0")
    assert sorted(len(list(g)) for g in _by(found)) == [5, 5, 5]
    again = community.detect_communities(edges).where("level = 0")
    assert values(found) == values(again)
    assert community.modularity(edges, found) > 0.5
    assert community.detect_communities(edges.where("false")).count() == 0


def _by(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["community"], []).append(r["id"])
    return out.values()


def test_bm25_equals_plain_python(spark):
    import math

    texts = ["a b c", "a a d", "b", "", "e f g a"]
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    want = [sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ["a", "b", "b"]) for t in toks]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["score"] for r in rank.bm25(rows, "a b b", F.col("t"), ["i"], normalise=False).orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_p95_rule(spark):
    for m in (19, 20, 41):
        xs = [float(i * i % 37) for i in range(m)]
        want = statistics.quantiles(xs, n=20)[18] if m >= 20 else statistics.mean(xs)
        df = spark.createDataFrame([(x,) for x in xs], "v double")
        assert df.agg(analytics.p95(F.col("v"))).first()[0] == pytest.approx(want)
        assert analytics.p95_ranked(df, "v").first()["p95"] == pytest.approx(want)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 9, 10)], "v double")
    assert values(analytics.histogram(df, "v"), "bin", "n") == [(0, 3), (4, 1)]
    assert values(analytics.histogram(df, "v", inclusive=True), "bin", "n") == [(0, 3), (4, 2)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert values(analytics.histogram(same, "v"), "bin", "n") == [(0, 2)]
    assert analytics.histogram(same.where("false"), "v").count() == 0


def test_trend_at_the_edge(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([100.0, 100.0, 105.0, 105.0])], "i int, v double")
    assert analytics.trend(df, "v", ["i"]).first()["trend"] == "increasing"


def test_change_detection(spark):
    new = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h")], "id string, content_hash string")
    old = spark.createDataFrame([("a", "h", 1), ("b", None, 2)], "id string, content_hash string, version int")
    assert values(incremental.changed(new, old), "id", "version", "is_changed") == [("a", 1, False), ("b", 3, True), ("c", 1, True)]


def test_delete_keeps_a_floor_of_one(spark):
    units = spark.createDataFrame([("t1", "d1"), ("t2", "d2")], "id string, document_id string")
    mentions = spark.createDataFrame([("t1", "x"), ("t2", "x"), ("t1", "y")], "text_unit_id string, entity_id string")
    entities = spark.createDataFrame([("x", 1), ("y", 1), ("z", 5)], "id string, mention_count long")
    claims = spark.createDataFrame([("c", "t1")], "claim_id string, text_unit_id string")
    left = incremental.delete_documents(spark.createDataFrame([("d1",)], "id string"), units, mentions, entities, claims)
    assert values(left["entities"]) == [("x", 1), ("z", 5)]
    assert left["claims"].count() == 0 and values(left["mentions"]) == [("t2", "x")]


def test_gleaning_stops_and_pacing_retries(spark):
    units = spark.createDataFrame([("c", "Alpha met Beta. Beta left."), ("n", None)], "chunk_id string, text string")
    rows = extraction.extract_with_gleaning(units, ["T"], passes=2).where("kind = 'entity'")
    assert {r["name"] for r in rows.collect()} == {"Alpha", "Beta"}
    calls, slept = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert clients.paced(flaky, spacing=0, sleep=slept.append)("p") == "ok" and slept == [1, 2]


def test_dedup_runs_pairwise_mean(spark):
    rows = [("A", "t", "x", 0.8, 0), ("a ", "T", "y", 0.4, 1), ("A", "t", " ", 1.0, 2)]
    out = extraction.dedup_entities(spark.createDataFrame(rows, "name string, type string, description string, confidence double, seq int")).collect()
    assert [(r["name"], r["confidence"], r["description"], r["mention_count"]) for r in out] == [("A", 0.8, "x | y", 3)]


def test_reasoning_reaches_depth_three(spark):
    ids = [f"n{i}" for i in range(6)]
    e = spark.createDataFrame([(i, f"name{i}", "t", "d", 1) for i in ids], "id string, name string, type string, description string, mention_count long")
    edges = spark.createDataFrame([(a, b, f"k{a}", 1.0) for a, b in zip(ids, ids[1:], strict=False)], "src string, dst string, rel_key string, confidence double")
    units = spark.createDataFrame([("u", "d", "text", 1)], "id string, document_id string, text string, start_char int")
    mentions = spark.createDataFrame([("u", "n0")], "text_unit_id string, entity_id string")
    out = reason.answer("where does it lead", e, edges, mentions, units, reason.Config(search_depth=3, search_width=1), start=["n0"])
    assert len(out.steps) == 3 and {t[2] for t in out.triplets} == {"n1", "n2", "n3"}
    with pytest.raises(ValueError):
        reason.answer("q", e, edges, mentions, units, reason.Config(search_depth=6))


def test_batches_and_validation():
    with pytest.raises(ValueError):
        globalqa.valid_questions([])
    with pytest.raises(ValueError):
        globalqa.valid_questions(["x" * 1001])
    with pytest.raises(ValueError):
        rank.strategy("none")


def test_upload_stream_is_idempotent(spark, tmp_path):
    from kgspark.sources.files import watch_uploads

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# one")
    (tmp_path / "in/b.txt").write_text("no")
    seen = []
    for _ in range(2):
        watch_uploads(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r["text"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["# one"]


def test_imports_without_the_training_data_folder():
    import subprocess
    import sys

    code = "import sys; sys.modules['kgspark.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    from conftest import ROOT

    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr


def test_runs_from_a_copy_without_the_training_data_files(tmp_path):
    """The files are gone, not masked: the entry imports, and no query of theirs is left."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/kgspark", f"{tmp_path}/kgspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and e.oracle_sql().keys() <= q.keys(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != root)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
