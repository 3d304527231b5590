"""Source divergence, benchmark decontamination and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from kgspark.llm import decontaminate, divergence, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDE = "doc_id long, text string, lang string, source string, n_words string, hits string, word string, n string, value string"


def wide(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in rows], WIDE)


def corpus(rng, n):
    words = [*(f"word{chr(97 + i)}x" for i in range(26)), "É", "über", "naïve", "東京", "A", "B1c"]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "C", None, "é"])))
    return [*rows, (n, None, "en", "only null"), (n + 1, "", "xx", "s1"), (n + 2, "rare", "xx", "s2"), (None, "WORDAX wordbx", "en", "a"), (n + 3, "wordax " * 50_000, "de", "long"), rows[0], rows[0]]


# source divergence


def brute_audit(rows, least, top):
    docs = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    seen, count = defaultdict(set), Counter()
    for i, (text, lang, source) in enumerate(docs):
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            t = t.translate(LOWER)
            seen[lang, t].add(i)
            count[lang, source, t] += 1
    kept = defaultdict(list)
    for (lang, t), found in seen.items():
        if len(found) >= least:
            kept[lang].append(t)
    groups = sorted({(lang, source) for _, lang, source in docs})
    p, q = {}, {}
    for lang, source in groups:
        v = kept[lang]
        n = sum(count[lang, source, t] for t in v)
        total = {t: sum(count[lang, s, t] for k, s in groups if k == lang) for t in v}
        for t in v:
            p[lang, source, t] = 1 + 10**9 * (count[lang, source, t] + 2) // (n + 2 * len(v))
            q[lang, t] = 1 + 10**9 * (total[t] + 2) // (sum(total.values()) + 2 * len(v))
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        pairs = [(sum(f(p[lang, source, t], p[lang, o, t]) for t in kept[lang]), o) for k, o in groups if k == lang and o != source]
        terms = [(f(p[lang, source, t], q[lang, t]), t) for t in kept[lang] if count[lang, source, t] and p[lang, source, t] > q[lang, t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, held", [(1, 300_000), (2, 5)])
def test_audit_equals_brute_force(spark, monkeypatch, seed, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus(random.Random(seed), 150)
    out = divergence.audit(wide(spark, rows), 4, 3)
    assert dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect())) == brute_audit(rows, 4, 3)
    assert divergence.audit(wide(spark, rows).where("false")).count() == 0


def test_probability_is_exact_beyond_longs(spark):
    df = spark.createDataFrame([(10**12 + 7, 3 * 10**13 + 1, 10**6)], "n long, total long, v long")
    assert df.select(divergence.probability("n", "total", "v")).first()[0] == 1 + 10**9 * (10**12 + 9) // (3 * 10**13 + 1 + 2 * 10**6)


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(rows, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    out = []
    for doc, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (win := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[win]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two, three four five"), (10, "three four FIVE six"), (2, "Ünï 7"), (3, ""), (4, None), (None, "five six seven eight"), (1, "eight nine ten eleven"), (20, "One two three four five"), (5, "solo")]
TEXTS = ["zero one two three", "zero ONE-two three\n\nfour five six seven eight", "x ünï 7 y", "x Ünï 7 solo", "nothing here at all", None, "", "eight nine ten eleven nine ten eleven", "one two three four five " * 3000, "solo", "Solo.", "东京 one two three 东京"]


@pytest.mark.parametrize("most", [decontaminate.MOST_WORDS, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    docs = wide(spark, [(i, t, None, "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[1], None, "s"), (1, TEXTS[1], None, "s")])
    items = spark.createDataFrame([(*x, "clash") for x in ITEMS], "item_id long, text string, hits string")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[1]), (1, TEXTS[1])]
    for size in (3, 4):
        got = decontaminate.find_leaks(docs, items, size, most_words=most)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=repr) == brute_leaks(rows, ITEMS, size)
        for r in got.collect():
            assert sum(h["last"] - h["first"] + 1 for h in r["hits"]) == r["n_hit"]
    assert decontaminate.find_leaks(docs.where("false"), items, most_words=most).count() == 0
    empty = decontaminate.digest(decontaminate.find_leaks(docs, items.where("false"), most_words=most)).collect()
    assert len(empty) == len(rows) and not any(r["contaminated"] or r["n_hit"] for r in empty)
    assert {r["items_sha256"] for r in empty} == {hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("most", [decontaminate.MOST_BYTES, 0])
def test_spans_and_documents_go(spark, most):
    docs = wide(spark, [(1, "Keep this. One two THREE, four — and 'solo' stays?", None, "s"), (2, "clean text", None, "s"), (3, None, "en", None), (4, "One two three", None, None)])
    items = spark.createDataFrame([(1, "one two three four"), (2, "solo"), (3, "one two three")], "item_id long, text string")
    cut = {r["doc_id"]: r for r in decontaminate.cut_leaks(docs, items, 3, most_bytes=most).collect()}
    assert cut[1]["text"] == "Keep this.  — and '' stays?" and cut[2]["text"] == "clean text" and cut[3]["text"] is None and cut[4]["text"] == ""
    assert cut[1]["hits"] == "clash" and cut[3]["lang"] == "en"
    left = decontaminate.drop_leaked(docs, items, 3, most_bytes=most)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "hashes", lambda norm, s, e: __import__("numpy").full(len(s), 77, "uint64"))
    index = decontaminate.Index([("a", b"one two three"), ("b", b"two three four")], 2)
    n, hit, items = index.scan(b"x two three y one two")
    assert (n, hit.tolist(), items) == (6, [False, True, True, False, True, True], ["a", "b"])
    assert index.scan(b"x y z")[2] == []


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, typo):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, found in close.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return sorted(out, key=repr)


def variant_rows(rng):
    base = ["letter", "lettre", "aaaaaaa", "aaaaaaab", "bookkeeper", "Straße", "éclairé", "mississippi", "abcdef"]
    words = []
    for w in base:
        family = {w}
        for _ in range(3):
            for x in list(family)[:12]:
                i, c = rng.randrange(len(x) + 1), rng.choice("abeé÷")
                family |= {x[:i] + c + x[i:], x[:i] + x[i + 1 :], x[:i] + c + x[i + 1 :]}
        words += sorted(family)[:25]
    rows = []
    for i in range(240):
        rows.append((i, rng.choice([" ", ", ", "1", "東"]).join(rng.choices(words, weights=[6 ** (k % 5) for k in range(len(words))], k=60)), "en", "s"))
    return [*rows, (None, "letter Letter LETTER", None, None), (7, None, None, None), (8, "", None, None), (9, "abcdef " * 30_000, None, None), (10, ("x" * 4000 + " ") * 5 + ("x" * 3999 + " ") * 6, None, None), rows[0], rows[0]]


@pytest.mark.parametrize("most, held", [(2000, 400_000), (6, 10)])
def test_variants_equal_brute_force(spark, monkeypatch, most, held):
    monkeypatch.setattr(spelling, "HELD", held)
    rows = variant_rows(random.Random(most))
    want = brute_variants(rows, 7)
    assert sum(x[4] for x in want) > 200 and any(x[1] and x[2] != x[1] for x in want)
    out = spelling.variants(wide(spark, rows), most=most, typo=7)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert spelling.variants(wide(spark, rows).where("false")).count() == 0


def test_shards_find_every_near_pair(spark):
    words = ["".join(x) for n in (6, 7) for x in itertools.product("ab", repeat=n)]
    df = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if near(a, b))
    for most in (3, 40, 10_000):
        assert sorted((r["word"], r["near"]) for r in spelling.near_pairs(df, most).collect()) == want


def test_count_filter_spares_most_verifications(monkeypatch):
    rng = random.Random(4)
    words = ["stem" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    made = []
    real = spelling.one_edit
    monkeypatch.setattr(spelling, "one_edit", lambda a, b: made.append(1) or real(a, b))
    list(spelling.near_in_shard(words, 10, 4, 10))
    assert len(made) < 400 * 399 / 2 / 20


def test_one_edit():
    for a, b in [("abc", "abc"), ("abc", "acb"), ("abcd", "ab"), ("", "")]:
        assert not spelling.one_edit(a, b) and not near(a, b)
    for a, b in [("aab", "ab"), ("abc", "axc"), ("abc", "abcc"), ("", "a")]:
        assert spelling.one_edit(a, b) and near(a, b)
