"""The pipeline's stages on a small table, each against plain Python."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from kgspark.llm import mixing, registry, toxicity


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "source_mixing", "byte_bpe"]


def rejected_by_loops(model, lang, text):
    """The network's output by Python loops over words, windows and filters, against the threshold of the language."""
    ids = [int(model.rows[1 + zlib.crc32(w.encode()) % (model.settings.buckets - 1)]) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    widest, z = max(model.settings.widths), float(model.out_bias)
    ids += [0] * widest
    for k, (tables, bias) in enumerate(zip(model.tables, model.bias, strict=True)):
        grid = [np.sum([t[ids[i + o]] for o, t in enumerate(tables)], axis=0) for i in range(len(ids) - len(tables) + 1)]
        for f, best in enumerate(np.max(grid, axis=0)):
            z += max(float(best) + float(bias[f]), 0.0) * float(model.out[k * len(bias) + f])
    score = 1 / (1 + math.exp(-(z * model.scale[0] + model.scale[1])))
    return score - model.by_lang.get(lang or "", model.threshold)


def first_of_each_class(rows):
    """Ids of the least document of each class of texts, by all pairs of word sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and sets[i] and len(sets[j]) >= 0.8 * len(sets[i]) >= 0.64 * len(sets[j]):
                n = len(sets[i] & sets[j])
                if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                    low, high = sorted((find(i), find(j)))
                    root[high] = low
    return {find(i) for i in ids}


SECRETS = (
    (r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8, "ASSIGN"),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16, "ACCESS"),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 32, "HEX"),
    (r"gh[pousr]_[A-Za-z0-9]+", lambda m: len(m[0]) == 40, "GITHUB"),
    (r"xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m[0]) >= 15, "SLACK"),
    (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=:,\\\t\n\r ]|-[A-Za-z0-9])*-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:(?:\r?\n|\\n)[A-Za-z0-9+/=]{16,})*)", lambda m: True, "PEM"),
)


def redacted(text):
    """Each rule by its own regular expression; spans that overlap become the mark of the one that begins first."""
    spans = sorted((m.start(), k, m.end()) for k, (pattern, ok, _) in enumerate(SECRETS) for m in re.finditer(pattern, text) if ok(m))
    out, done, i = "", 0, 0
    while i < len(spans):
        start, k, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += text[done:start] + f"[{SECRETS[k][2]}]"
        done = end
    return out + text[done:]


def mixed_by_hand(rows, mix):
    """Ids in the order of an earliest-deadline-first simulation, slot by slot, that skips lanes which ran out."""
    share = mix.lanes()
    lanes = list(share)
    waiting = {k: sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, source in rows if (source if source in mix.weights else mixing.OTHER) == k) for k in lanes}
    done, order, slot = dict.fromkeys(lanes, 0), [], 0
    while any(waiting.values()):
        ready = [(-(-(done[k] + 1) * mix.period // share[k]), n, k) for n, k in enumerate(lanes) if done[k] * mix.period // share[k] <= slot]
        lane = min(ready)[2]
        done[lane] += 1
        slot += 1
        order += [i for _, i in waiting[lane][: mix.block]]
        del waiting[lane][: mix.block]
    return order


def test_each_stage(spark, sf):
    """Every stage on its own input against plain Python that shares no code with its operator."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = corpus_pipeline.toxicity_filter(spark, docs, sf)
    away = {r["doc_id"]: rejected_by_loops(model, r["lang"], r["text"]) for r in docs.collect()}
    left = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and 0 < len(left) < len(away)
    assert all((away[i] < 0) == (i in left) for i in away if abs(away[i]) > 1e-5)

    one = corpus_pipeline.near_duplicate_filter(spark, kept, sf)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(first_of_each_class([(r["doc_id"], r["text"]) for r in kept.collect()]))

    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "A1b2" * 16 + "\n-----END RSA PRIVATE KEY-----"
    planted = ['é password = "hunter2hunter2" and', "AKIA" + "Q" * 12 + " token:" + "0a" * 20, "ghp_" + "A" * 36, "xoxb-123456789012", f"before {key} after", "0123456789abcdef" * 2 + key]
    base = docs.first().asDict()
    one = one.unionByName(spark.createDataFrame([tuple((base | {"doc_id": 9_000_000 + i, "text": t, "n_chars": len(t)})[c] for c in docs.columns) for i, t in enumerate(planted)], docs.schema))
    clean = corpus_pipeline.secret_redaction(spark, one, sf)
    got = {r["doc_id"]: r for r in clean.collect()}
    before = {r["doc_id"]: r for r in one.collect()}
    assert clean.columns == docs.columns and got.keys() == before.keys()
    assert all(got[i]["text"] == redacted(before[i]["text"]) and got[i]["lang"] == before[i]["lang"] for i in got)
    assert all(got[i]["text"] != before[i]["text"] and got[i]["n_chars"] == len(got[i]["text"]) for i in range(9_000_000, 9_000_000 + len(planted)))

    order = corpus_pipeline.source_mixing(spark, clean, sf)
    assert order.columns == docs.columns
    assert [r["doc_id"] for r in order.collect()] == mixed_by_hand([(r["doc_id"], r["source"]) for r in got.values()], registry.MIX)

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(registry.RANKS), "rb"))}, special_tokens={})
    digests = {r["doc_id"]: r for r in corpus_pipeline.tokenization(spark, order, sf).collect()}
    assert digests.keys() == got.keys()
    for i, r in got.items():
        ids = library.encode_ordinary(r["text"])
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()
        assert (digests[i]["n_tokens"], digests[i]["ids_sha256"], digests[i]["decoded_sha256"]) == want


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns; then an empty table."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i * k + k * k) % 10] + str(i) for k in range(40)), "en", "src0", 10) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "x", 0), (102, "   ", None, None, 3), (None, "no id here at all, none", "en", "src1", 5), (0, rows[0][1], "en", "src0", 10), (103, rows[1][1], "de", None, 10), (104, "word " * 50_000, "en", "src2", None), (105, 'password = "hunter2hunter2"', "en", "src2", 27)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1.5 AS score", "'x' AS node", "'y' AS key", "array(1) AS ids")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(20)] + [(None, None, 1)], "doc_id long, quality int, toxic int")
    for name, part in (("odd", docs), ("none", docs.where("false"))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    d = f"{tmp_path}/odd"
    one = corpus_pipeline.near_duplicate_filter(spark, docs, d)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one.collect())
    assert one.columns == docs.columns
    assert kept == sorted([(False, i) for i in range(40)] + [(False, i) for i in (100, 101, 102, 104, 105)] + [(True, 0)])
    clean = {r["doc_id"]: r for r in corpus_pipeline.secret_redaction(spark, docs, d).collect()}
    assert clean[105]["text"] == "[ASSIGN]\"" and clean[105]["n_chars"] == 9 and clean[104]["n_chars"] is None and clean[0]["ids"] == [1]
    assert corpus_pipeline.source_mixing(spark, docs, d).count() == docs.count()
    out = corpus_pipeline.run(spark, d)
    assert out.count() == out.dropDuplicates(["doc_id"]).count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
