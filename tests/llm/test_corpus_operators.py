"""Operators over whole tables against brute force on small fixtures."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kgspark.llm import ann, mixing, neardup, registry, suffixtree, urlfilter


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# URL filter

URLS = [
    "https://a.example.net/en/1", "http://b.example.net/de/2", "http://net/", "https://x.example.com/de/3?q=1", "https://x.example.com/en/4#t", "HTTP://Sub.ORG/fr/x", "https://shop.org/en/9",
    "no scheme", "", None, "http://example.netx/en/", "http://É.example.net/en/ü", "://host/p", "ftp://u@org/fr/", "http://notexample.com/de/", "http://a?b://c/d",
]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    m = min([i for i, c in enumerate(rest) if i >= n and c in "?#"] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:m]


def rule_of(host, path):
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def symbols(url):
    out = []
    for c in url or "":
        low = c.lower() if c.isascii() else c
        out.append(urlfilter.LETTERS.index(low) + 1 if low in urlfilter.LETTERS else 27 if c in urlfilter.DIGITS else 28 if c == "." else 29 if c == "/" else 30 if c in urlfilter.DASH else 31 if c in urlfilter.MARKS else 0)
    return out


def brute_log_p(train, window):
    """Witten-Bell probability of the last symbol of a window, context by context."""
    p = 1 / 32
    for k in range(3):
        ctx = window[2 - k : 2]
        after = collections.Counter(w[2] for w in train if w[2 - k : 2] == ctx)
        n, t = sum(after.values()), len(after)
        p = (after[window[2]] + t * p) / (n + t) if n else p
    return math.log(p)


def windows(url):
    s = [0, 0, *symbols(url)]
    return [tuple(s[i : i + 3]) for i in range(len(s) - 2)]


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(1)
    made = [f"http://{rng.choice(['blog', 'm', 'spam-farm'])}.{rng.choice(['example.net', 'example.com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(99)}" for _ in range(60)]
    urls = [*URLS, *made, made[0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS rule", "null AS score")
    out = urlfilter.filter_urls(pages).collect()
    assert len(out) == len(urls)
    hashed = {r["url"]: r["h"] for r in pages.selectExpr("url", "pmod(xxhash64(url), 5) AS h").collect()}
    train = {True: [], False: []}
    for u in urls:
        if u is not None and (r := rule_of(*split_url(u))) and hashed[u]:
            train[r.allow] += windows(u)
    for row in out:
        u = urls[row["page_id"]]
        host, path = split_url(u)
        rule = rule_of(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule.name if rule else None)
        score = sum(brute_log_p(train[True], w) - brute_log_p(train[False], w) for w in windows(u)) / max(1, len(u or ""))
        assert row["score"] == pytest.approx(score, abs=1e-5)
        assert row["verdict"] == ("allow" if (rule.allow if rule else row["score"] >= row["threshold"]) else "block")
    assert urlfilter.filter_urls(pages.where("false")).count() == 0


def test_url_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urlfilter.filter_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_threshold_by_balanced_accuracy():
    assert urlfilter.calibrated_threshold([(-500, 0, 4), (-100, 1, 1), (300, 5, 0)]) in (-0.1, 0.3)
    assert urlfilter.calibrated_threshold([(1, 3, 0)]) == 0.0


# mixing


def test_period_deviates_by_less_than_a_block():
    rng = random.Random(3)
    for _ in range(30):
        share = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        plan, q, done = mixing.period_slots(share), sum(share), [0] * len(share)
        for t, lane in enumerate(plan):
            done[lane] += 1
            assert all(abs(n - (t + 1) * p / q) < 1 for n, p in zip(done, share, strict=True))
        assert done == share


def test_mixing_equals_a_simulation_and_sql(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "zz"])) for i in range(700)]
    mix = mixing.Mix({"a": 0.2, "b": 0.5, "c": 0.2}, other=0.1, period=20, block=8, digits=2)
    docs = spark.createDataFrame([*rows, (None, "a")], "doc_id long, source string")
    out = mixing.mixed(docs, mix).collect()
    assert sorted(r["mix_position"] for r in out) == list(range(701))
    import hashlib

    lanes = list(mix.lanes())
    queue = {k: sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i) for i, s in [*rows, (None, "a")] if (s if s in mix.weights else mixing.OTHER) == k) for k in lanes}
    plan, order, slot = mixing.period_slots(list(mix.lanes().values())), [], 0
    while any(queue.values()):
        lane = lanes[plan[slot % 20]]
        order += [i for _, i in queue[lane][:8]]
        queue[lane] = queue[lane][8:]
        slot += 1
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["mix_position"])] == order
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in out)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*rows, (None, "a")])
    want = con.execute(mixing.oracle_sql(mix)).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["source"], r["mix_lane"], r["mix_block"], r["mix_slot"], r["mix_release"], r["mix_deadline"], r["mix_position"]) for r in out), key=key) == sorted(want, key=key)
    assert mixing.mixed(docs.where("false"), mix).count() == 0


def test_mixing_keeps_input_columns_and_splits_null_ids(spark):
    mix = mixing.Mix({"a": 0.5, "b": 0.3}, other=0.2, period=10, block=4)
    rows = [(i if i % 3 else None, "ab"[i % 2], f"v{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_key string").selectExpr("*", "'kept' AS mix_in", "'gone' AS mix_position", "map(1, 2) AS m")
    out = mixing.mixed(docs, mix)
    assert sorted(out.columns) == sorted([*docs.columns, "mix_lane", "mix_block", "mix_slot", "mix_release", "mix_deadline"])
    got = out.collect()
    assert sorted(r["mix_position"] for r in got) == list(range(600)) and {r["mix_in"] for r in got} == {"kept"}
    assert sorted(r["mix_key"] for r in got) == sorted(r[2] for r in rows)
    import hashlib

    for lane in ("a", "b"):  # the fixed shuffle, null ids among the others
        own = [r["doc_id"] for r in sorted(got, key=lambda r: r["mix_position"]) if r["source"] == lane]
        assert own == sorted(own, key=lambda i: hashlib.md5(b"" if i is None else str(i).encode()).hexdigest())
    other = mixing.mixed(docs, mix, prefix="own_")
    assert {r["mix_position"] for r in other.collect()} == {"gone"}


def test_shares_add_up():
    lanes = registry.MIX.lanes()
    assert sum(lanes.values()) == registry.MIX.period and min(lanes.values()) >= 1
    with pytest.raises(ValueError):
        mixing.shares({"a": 0}, 1, 10)


# suffix tree


def brute_counts(texts):
    c = collections.Counter()
    for t in texts:
        c.update(suffixtree.words(t))
    return c


def brute_tree(texts, s):
    """Nodes of the tree from plain counts: context -> (kept, back-off)."""
    c = brute_counts(texts)
    n, v = sum(c.values()), len(c)
    frequent = {w for w, k in c.items() if k >= max(1, s.p_min * n)}
    start = object()
    base = lambda w: (c[w] + 1) / (n + v + 1)
    one, two, size1, size2 = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        seq = [start, *suffixtree.words(t)]
        for i in range(1, len(seq)):
            one[seq[i - 1], seq[i]] += 1
            size1[seq[i - 1]] += 1
            if i > 1:
                two[seq[i - 2], seq[i - 1], seq[i]] += 1
                size2[seq[i - 2], seq[i - 1]] += 1
    known = lambda w: w is start or w in frequent
    nodes = {}

    def keep(ctx, after, size, parent):
        good = {w: k for w, k in after.items() if w in frequent and k >= 2 and k >= s.gamma_min * size}
        good = {w: k for w, k in good.items() if k / size >= s.ratio * parent(w) or k / size * s.ratio <= parent(w)}
        q = sum(map(parent, good))
        p = sum(good.values()) / size
        if not good or q >= 1:
            return
        gain = sum(k * math.log(k / size / parent(w)) for w, k in good.items()) + (size * (1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
        if gain >= s.cost * len(good) * math.log(n) / 2:
            kept = {w: (k - s.discount) / size for w, k in good.items()}
            nodes[ctx] = kept, (1 - sum(kept.values())) / (1 - q)

    least = max(2.0, s.p_min * n)
    for a in {x for x, _ in one if known(x)}:
        keep((a,), {w: k for (x, w), k in one.items() if x == a}, size1[a], base)

    def prob(ctx, w):
        while ctx and ctx not in nodes:
            ctx = ctx[1:]
        if not ctx:
            return base(w)
        kept, back = nodes[ctx]
        return kept[w] if w in kept else back * prob(ctx[1:], w)

    for (a, b), size in size2.items():
        if known(a) and known(b) and b != suffixtree.END and size >= least and one[a, b] >= least:
            keep((a, b), {w: k for (x, y, w), k in two.items() if (x, y) == (a, b)}, size, lambda w, b=b: prob((b,), w))
    return prob, start, c, n, v


def test_suffix_tree_equals_brute_force(spark):
    rng = random.Random(6)
    phrase = "to whom it may concern this is the license text".split()
    texts = []
    for i in range(300):
        words = [rng.choice("the of and to it a rare".split()) if rng.random() < 0.7 else f"w{rng.randrange(900)}" for _ in range(rng.randrange(0, 30))]
        texts.append(" ".join(words + (phrase if i % 3 == 0 else [])))
    texts += [None, "", "THE  Of\tthe\x0bof", "é É", texts[0]]
    s = suffixtree.Settings(p_min=2e-3, gamma_min=0.05, flush=200)
    docs = spark.createDataFrame([*enumerate(texts), (None, "the of")], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS row")
    out = suffixtree.score_documents(spark, docs, s).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    every = [*enumerate(texts), (None, "the of")]
    prob, start, c, n, v = brute_tree([t for i, t in every if not fold(i)], s)
    assert len(out) == len(every)
    gained = 0.0
    for r in out:
        text = "the of" if r["doc_id"] is None else texts[r["doc_id"]]
        seq = [start, *suffixtree.words(text)]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in seq[1:])
        score = sum(math.log10(prob(tuple(seq[max(0, i - 2) : i]), seq[i])) for i in range(1, len(seq)))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]), len(seq) - 1, sum(c[w] > 0 for w in seq[1:]), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        gained += score - base
    assert gained > 0
    empty = suffixtree.score_documents(spark, docs.where("doc_id = 2"), s).collect()
    assert len(empty) == 1
    assert suffixtree.score_documents(spark, docs.where("false"), s).count() == 0


def test_suffix_tree_is_a_distribution():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("a b c d".split()) for _ in range(20)) + " x y z" for _ in range(50)]
    prob, start, c, n, v = brute_tree(texts, suffixtree.Settings(p_min=1e-3))
    for ctx in ((), ("a",), (b"x",), (b"x", b"y"), (start,)):
        assert sum(prob(ctx, w) for w in c) + prob(ctx, b"never seen") == pytest.approx(1)


def brute_scores(train, texts, s):
    """log10 scores of ``texts`` from plain counts, for contexts of any length."""
    c = brute_counts(train)
    n, v = sum(c.values()), len(c)
    start, after = object(), collections.defaultdict(collections.Counter)
    for t in train:
        seq = [start, *suffixtree.words(t)]
        for i in range(1, len(seq)):
            for k in range(1, min(s.depth, i) + 1):
                after[tuple(seq[i - k : i])][seq[i]] += 1
    nodes = {}

    def prob(ctx, w):
        if not ctx:
            return (c[w] + 1) / (n + v + 1)
        if ctx not in nodes:
            return prob(ctx[1:], w)
        kept, back = nodes[ctx]
        return kept[w] if w in kept else back * prob(ctx[1:], w)

    for ctx in sorted(after, key=len):
        size, good = sum(after[ctx].values()), {}
        for w, k in after[ctx].items():
            q = prob(ctx[1:], w)
            if k >= s.least and k >= s.gamma_min * size and (k / size >= s.ratio * q or k / size * s.ratio <= q):
                good[w] = k, q
        p, q = sum(k for k, _ in good.values()) / size, sum(q for _, q in good.values())
        if size < s.least or not good or q >= 1:
            continue
        gain = sum(k * math.log(k / size / q) for k, q in good.values()) + (size * (1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
        if gain >= s.cost * len(good) * math.log(n) / 2:
            kept = {w: (k - s.discount) / size for w, (k, _) in good.items()}
            nodes[ctx] = kept, (1 - sum(kept.values())) / (1 - q)
    out = []
    for t in texts:
        seq = [start, *suffixtree.words(t)]
        out.append(sum(math.log10(prob(tuple(seq[max(0, i - s.depth) : i]), seq[i])) for i in range(1, len(seq))))
    return out, nodes


def test_packed_columns_come_back():
    from kgspark.llm.packs import narrow, pack, unpack

    rng = np.random.default_rng(40)
    for n in (0, 1, 1000):
        columns = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)), rng.standard_normal(n), narrow(rng.integers(0, 70_000, n)), np.zeros(3, np.int8)]
        got = unpack(pack(*columns))
        assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(columns, got, strict=True))


@pytest.mark.parametrize("s", [suffixtree.Settings(flush=200, bucket=500), suffixtree.Settings(depth=4, least=3, hot=5e-3, flush=200)])
def test_suffix_tree_keeps_long_contexts(spark, s):
    rng = random.Random(16)
    phrases = [[f"p{i}{j}" if rng.random() < 0.5 else rng.choice("the of and".split()) for j in range(8)] for i in range(30)]
    texts = [None, "", "the of", "  The OF  "]
    for _ in range(250):
        words = [rng.choice("the of and to it a".split()) for _ in range(rng.randrange(0, 20))]
        texts.append(" ".join(words + (rng.choice(phrases) if rng.random() < 0.6 else [f"w{rng.randrange(900)}"])))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in suffixtree.score_documents(spark, docs, s).collect()}
    want, nodes = brute_scores([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], texts, s)
    assert max(map(len, nodes)) == s.depth and len(out) == len(texts)
    for i, score in enumerate(want):
        assert out[i] == pytest.approx(score)


def test_suffix_tree_learns_rare_passages_in_much_text(spark):
    """A passage of 6 texts among 780,000 tokens, of which it is less than a 1e-5 share."""
    rng = random.Random(17)
    passage = " ".join(f"rare{i}" for i in range(12))
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    with_passage = {*[i for i in range(100) if not fold(i)][:6], next(i for i in range(100) if fold(i))}
    texts = [(i, " ".join(rng.choices("a b c d e f g h".split(), k=900)) if i not in with_passage else passage) for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffixtree.score_documents(spark, docs).where(f"doc_id in {tuple(with_passage)}").collect()}
    assert len(rows) == 7 and all(r["train_tokens"] * 1e-5 > 6 for r in rows.values())
    for r in rows.values():  # all words but the first are sure once the passage has begun
        assert r["score"] - r["base_score"] > 11 * 4


def test_suffix_tree_hashes_words_whatever_lies_around_them():
    rng = random.Random(18)
    texts = ["", None, " ", "A", "a\tb", "Long" * 17, ("x" * 64 + " ") * 3, "y" * 65, "ÄÖ\x0bäö \x1c\u00a0", "z" * 300_000 + " Z"]
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(40))) for _ in range(20_000)]
    of, n = {}, 0
    for lo, hi, flat, starts in suffixtree.encoded(pa.array([None, *texts])[1:]):
        assert hi - lo == len(starts) - 1 and lo == n
        n = hi
        for i in range(lo, hi):
            own = flat[starts[i - lo] : starts[i - lo + 1]]
            assert own[0] == suffixtree.START and len(own) == 1 + len(suffixtree.words(texts[i]))
            for w, h in zip(suffixtree.words(texts[i]), own[1:].tolist(), strict=True):
                assert of.setdefault(w, h) == h
    assert n == len(texts) and len(set(of.values())) == len(of) > 500


def test_suffix_tree_sums_of_a_block_come_back_in_one_row_a_bucket():
    """They were one row for each document and bucket: 29 million of them for 256,410 documents."""
    none, docs, buckets = np.zeros(0), 400, 8
    block = suffixtree._Block(suffixtree.Hot(none.astype(np.uint64), none, none.astype(np.uint64), none, none.astype(np.uint64), none, none), 5, buckets)
    keys = np.random.default_rng(18).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    block.docs.append((np.arange(docs), np.zeros(docs, np.uint8), np.zeros(docs, np.uint8), np.full(docs, 1000)))
    block.n = docs
    block.add(suffixtree.IN_WORDS, np.repeat(np.arange(docs), 1000), np.tile(keys, docs))
    parts = suffixtree._slices(np.sort(keys), buckets)
    tables = [(k, suffixtree.WORDS, None, suffixtree.pack(np.sort(keys)[part], np.ones(part.stop - part.start))) for k, part in parts]
    rows = sorted([*tables, *block.rows()], key=lambda r: r[:2])
    met = [*suffixtree._meet([suffixtree._packed_batch(rows)])]
    assert sum(b.num_rows for b in met) == buckets + 1
    out = pa.Table.from_batches([*suffixtree._add(met)]).to_pydict()
    assert out["n_known"] == [1000] * docs and out["base"] == [1000.0] * docs


# nearest neighbours


def brute_nearest(ids, m, k=5):
    norm = np.sqrt((m * m).sum(axis=1))
    out = set()
    for i, q in enumerate(ids):
        if q % 50 == 0:
            sim = (m @ m[i]) / (norm * norm[i])
            order = sorted((-round(float(x), 12), j) for j, x in zip(ids, sim, strict=True) if j != q)
            out |= {(q, j) for _, j in order[:k]}
    return out


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((8, 24))
    m = (centres[rng.integers(0, 8, 2500)] + rng.standard_normal((2500, 24))).astype(np.float32)
    m[1000:1400] = m[0]  # one very common vector
    ids = list(range(2500))
    rows = [(i, m[i].tolist()) for i in ids]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] + [1.0] * 23), (5200, [1.0, 2.0]), (None, [1.0] * 24), (5250, []), (5300, [float("inf")] * 24)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    out = ann.nearest(vectors).collect()
    found = {(r["query_id"], r["vec_id"]) for r in out}
    want = brute_nearest(ids, m.astype(np.float64))
    assert len(out) == 50 * 5 and len(found & want) / len(want) >= 0.9
    assert {q for q, _ in found} == {i for i in ids if i % 50 == 0}
    for r in out:
        a, b = m[r["query_id"]].astype(np.float64), m[r["vec_id"]].astype(np.float64)
        assert r["score"] == pytest.approx(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), abs=1e-12)
    copies = [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 1050]
    assert copies == [0, 1000, 1001, 1002, 1003]


@pytest.mark.parametrize("noise", [1e-6, 5e-5])
def test_nearest_in_a_clump(spark, noise):
    """A third of the rows are nearly, but not quite, the same vector."""
    rng = np.random.default_rng(18)
    m = rng.standard_normal((9000, 32)).astype(np.float32)
    m[::3] = (m[0] * (1 + noise * rng.standard_normal((3000, 32)))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    found = collections.defaultdict(dict)
    for r in ann.nearest(vectors).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    x = m.astype(np.float64)
    norm, hits = np.sqrt((x * x).sum(axis=1)), []
    for q in range(0, 9000, 150):  # the queries of the clump
        score = (x * x[q]).sum(axis=1) / norm / norm[q]
        score[q] = -2
        least = np.sort(score)[-5] - 1e-15
        hits.append(sum(score[j] >= least for j in found[q]) / 5)
    assert np.mean(hits) >= 0.9


def test_best_gives_ties_to_the_smaller_id():
    rows = np.concatenate([np.outer(2.0 ** np.arange(40), [1.0, 1.0]), [[1.0, 0.0]]])  # rescaled copies
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    ids = np.concatenate([np.arange(40)[::-1], [99]])
    top, score = ann.best(np.array([1.0, 2.0]), rows, unit, ids, 6)
    assert ids[top].tolist() == [0, 1, 2, 3, 4, 5] and len(set(score.tolist())) == 1


def test_nearest_ties_of_parallel_doubles(spark):
    """40 vectors of one direction are distinct and equally near; components beyond single precision stay."""
    rows = [(0, [1.0, 2.0, 0.5])] + [(i, [2.0**i, 2.0**i, 0.0]) for i in range(1, 41)] + [(50, [1e39, 1e39, 1e39]), (51, [1e-200, 2e-200, 0.5e-200]), (52, [1e300, 2.0000001e300, 0.5e300])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = {q: [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert found[0] == [51, 52, 1, 2, 3]
    one = {r["vec_id"]: r["score"] for r in out if r["query_id"] == 0}
    assert one[51] == pytest.approx(1, abs=1e-15) and 1 - 1e-13 < one[52] < 1
    tied = ann.nearest(spark.createDataFrame(rows[:1] + rows[1:41], "vec_id long, embedding array<double>")).collect()
    assert [r["vec_id"] for r in sorted(tied, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5] and len({r["score"] for r in tied}) == 1


def test_windows_across_ranges_equal_whole_curves(spark):
    """Every query sees its whole window: results are those of one range, and work does not grow with the rows."""
    rng = np.random.default_rng(28)
    m = rng.standard_normal((3000, 12)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    few = {"curves": 3, "window": 20, "coords": 4}
    one = rows_of(ann.nearest(vectors, s=ann.Settings(**few, range_rows=10_000)))
    many = rows_of(ann.nearest(vectors, s=ann.Settings(**few, range_rows=300)))
    best = lambda rows: {(q, r): score for q, r, _, score in rows}
    a, b = best(one), best(many)
    assert a.keys() == b.keys() and all(b[k] >= a[k] for k in a)  # a visitor sees a full window of the next range
    assert np.mean([b[k] == a[k] for k in a]) > 0.9


def test_window_holds_no_more_than_it_needs():
    rng = np.random.default_rng(29)
    m, w, seen = rng.standard_normal((5000, 6)), ann.Window(30, 4), {}
    ids = np.arange(5000)
    for a in range(0, 5000, 700):
        part = slice(a, a + 700)
        w.add(ids[part], ids[part], ids[part], m[part], ids[part] % 50 == 0, np.zeros(len(ids[part]), dtype=bool))
        for last in (False, True) if a + 700 >= 5000 else (False,):
            for r in w.take(last).to_pylist():
                seen.setdefault(r["q1"], []).append(r["c1"])
        assert len(w.rows[0]) <= 2 * 30 + 50 + 1
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 5000, 50):
        near = range(max(0, q - 30), min(5000, q + 31))
        assert seen[q] == sorted(near, key=lambda i: -(unit[i] @ unit[q]))[:4]


def test_nearest_few_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert rows_of(ann.nearest(vectors), "query_id", "rank", "vec_id") == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(vectors.where("false")).count() == 0


def test_hilbert_steps_to_neighbours():
    side = np.arange(8)
    points = np.array([(x, y, z) for x in side for y in side for z in side])
    order = np.argsort(ann.hilbert(points, 3))
    assert sorted(ann.hilbert(points, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


# near duplicates


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, n = [], 0
    for group in range(40):
        base = [word() for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.choice([1, 2, 3, 30 if group == 0 else 4])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            docs.append((n, " ".join(t)))
            n += 1
    passage = " ".join(word() for _ in range(60))
    docs += [(n + i, passage + " " + " ".join(word() for _ in range(150))) for i in range(40)]
    n += 40
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\u2003"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "a b c d e f"), (None, docs[0][1]), (3, docs[3][1]), (n + 6, docs[0][1].upper())]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS node", "'y' AS class_id", "'z' AS key")
    out = neardup.near_duplicates(table, neardup.Settings(chunk=8)).collect()
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    links = [0] * len(docs)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and inter / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    members = collections.defaultdict(list)
    for i in range(len(docs)):
        members[find(i)].append(docs[i][0])
    want = sorted((d is None, d or 0, min((x for x in members[find(i)] if x is not None), default=None), links[i]) for i, (d, _) in enumerate(docs))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in out) == want
    kept = neardup.keep_first(table, neardup.Settings(chunk=8))
    assert kept.columns == table.columns
    classes = {find(i) for i in range(len(docs)) if sets[i]}
    assert kept.count() == len(classes) + 3
    assert sorted(r["doc_id"] for r in kept.collect() if (r["text"] or "").strip()) == sorted(min(x for x in members[c] if x is not None) for c in classes)
    assert neardup.near_duplicates(table.where("false")).count() == 0


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = neardup.overlaps(sets)
    assert all(got[i][j] == want[i][j] for i in range(30) for j in range(30) if i != j)


def test_prefix_is_shortened_to_the_target():
    s = neardup.Settings()
    assert 1 - (1 - 0.8**s.least) ** s.trees >= s.target > 1 - (1 - 0.8 ** (s.least + 1)) ** s.trees and s.least < s.longest


def test_forest_matches_the_longest_prefix_first():
    """Walking a sorted trie: each node meets the head of its deepest run, then of shorter ones, by the labels' own prefixes."""
    s, rng = neardup.Settings(trees=1), random.Random(31)
    for _ in range(60):
        rows = sorted({(bytes([1] * 2 * s.least) + bytes(x for _ in range(s.longest - s.least) for x in (0, rng.randrange(3)))): i for i in range(rng.randrange(1, 40))}.items())
        climb, out = neardup.Climb(s), []
        for label, i in rows:
            out += climb.step(7, label, str(i).encode())
        seen = []
        for label, i in rows:
            node = str(i).encode()
            met = [(n, h, d) for _, n, h, d, _ in out if n == node and d]
            want, heads = [], set()
            for d in range(s.longest, s.least - 1, -1):
                head = next((str(j).encode() for other, j in seen if other[: 2 * d] == label[: 2 * d]), None)
                if head and head not in heads:
                    heads.add(head)
                    want.append((node, head, d))
            assert met == want
            seen.append((label, i))
        assert sorted(x[1] for x in out if x[4]) == sorted(str(i).encode() for _, i in rows) * (len(rows) > 1)
        assert ([x for x in out if x[3] == 0] != []) == (len(rows) > 1)


def test_forest_runs_cross_batches(spark):
    """Members of every run of the shortest prefix, whatever the batches of Arrow."""
    rng, s = random.Random(32), neardup.Settings(trees=2)
    data = [(i.to_bytes(4, "big"), [bytes([0, rng.randrange(2)] * s.least) + rng.randbytes(2 * (s.longest - s.least)) for _ in range(2)]) for i in range(300)]
    nodes = spark.createDataFrame(data, "node binary, labels array<binary>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = neardup.forest(nodes, s).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    runs = collections.defaultdict(set)
    for r in rows:
        assert not r["first"] or bytes(r["node"]) not in runs[r["key"]]
        runs[r["key"]].add(bytes(r["node"]))
    want = collections.defaultdict(set)
    for node, trees in data:
        for t, label in enumerate(trees):
            want[t, label[: 2 * s.least]].add(node)
    assert sorted(map(sorted, runs.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_near_duplicates_with_a_hot_id(spark):
    """Null ids and a repeated id over many texts; input columns of any name."""
    base = [f"w{i}" for i in range(50)]
    rows = [(None, " ".join(f"n{k}x{j}" for j in range(30))) for k in range(60)] + [(7, " ".join(f"h{k}x{j}" for j in range(30))) for k in range(60)] + [(None, " ".join(base)), (7, " ".join(base)), (8, " ".join([*base[:-1], "z"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS near_rid_", "'b' AS near_node_", "1 AS th", "2 AS node")
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == 123 and sum(r["n_links"] for r in out) == 6 and [r["class_id"] for r in out if r["n_links"]] == [7, 7, 7]
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == 121
    assert {(r["near_rid_"], r["near_node_"]) for r in kept.collect()} == {("a", "b")}


def test_members_and_pairs_are_planned_apart_from_the_texts_they_meet(spark, monkeypatch):
    plans, real = {}, neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, tag: (plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}), real(df, tag))[1])
    docs = spark.createDataFrame([(i, f"{'one two three four five six seven eight nine ten ' * 3}{i % 2}", "en", "x", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars int")
    assert {(r["class_id"], r["n_links"]) for r in neardup.near_duplicates(docs).collect()} == {(0, 5)}
    assert "near-members" in plans["near-links"] and "near-pairs" in plans["near-links"] and "near-runs" not in plans["near-links"]
