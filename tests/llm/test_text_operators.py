"""Row-wise operators against their public libraries or brute force."""

import hashlib
import pickle
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from kgspark.llm import automaton, bpe, media, registry, secrets, unigram

RANKS = public_tokenizers.path(registry.RANKS)
PIECES = public_tokenizers.path(registry.PIECES)
CODEC = bpe.codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(open(RANKS, "rb").read()), special_tokens={})
ODD = [("empty", ""), ("null", None), ("repeat", "token token"), ("repeat", "token token"), ("long", "ab1 " * 30_000), ("run", "é" * 3000), ("space", " \n\t  "), ("mixed", "naïve 東京 12½ \u2003x")]
WIDE = "doc_id long, text string, lang string, source string, n_tokens string, score string, spans string"


def odd_docs(spark):
    rows = [(i, t, None if i % 2 else "en", None, "clash", "clash", "clash") for i, (_, t) in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None, None, None)], WIDE)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_bpe_equals_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text("ab Ж東é1\n'", max_size=40))
def test_bpe_equals_library_beyond_latin(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_bpe_query_on_odd_rows(spark):
    out = {r["doc_id"]: r for r in bpe.encode_documents(spark, odd_docs(spark), RANKS, digest=True).collect()}
    assert len(out) == len(ODD) + 1
    for i, (_, t) in enumerate(ODD):
        ids = LIBRARY.encode_ordinary(t or "")
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(spark, odd_docs(spark).where("false"), RANKS).count() == 0
    full = bpe.encode_documents(spark, odd_docs(spark).where("doc_id = 7"), RANKS).first()
    assert full["decoded"] == ODD[7][1]


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(3000)) and h.at == list(map(h.slot, keys))


def hf_tokenizer(vocab, unknown, fallback):
    t = Tokenizer(models.Unigram(vocab, unk_id=unknown, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.SPACE_MARK, prepend_scheme="always", split=True)
    return t


VOCAB = unigram.read_model(PIECES)
COUNTER = unigram.Counter(VOCAB)
HF = hf_tokenizer([(p, s) for p, s, _ in VOCAB], 0, True)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("the andion Zéß東😀\n.,1▁\x07"), max_size=40))
def test_unigram_count_equals_library(text):
    assert COUNTER.text(text)[0] == len(HF.encode(text).ids)


@settings(max_examples=300, deadline=None)
@given(st.text("abc d", max_size=14), st.integers(0, 10**6))
def test_unigram_ties_without_bytes(text, seed):
    rng = random.Random(seed)
    pieces = ["a", "b", "ab", "ba", "aba", "bab", "▁", "▁a", "▁ab", "d", "dd"]
    vocab = [("<unk>", 0.0)] + [(p, -float(rng.randrange(1, 4))) for p in pieces]
    own = unigram.Counter([(p, s, "unknown" if p == "<unk>" else "normal") for p, s in vocab])
    assert own.text(text)[0] == len(hf_tokenizer(vocab, 0, False).encode(text).ids)


def test_unigram_query_on_odd_rows(spark):
    out = {r["doc_id"]: r["n_tokens"] for r in unigram.count_tokens(spark, odd_docs(spark), PIECES).collect()}
    assert all(out[i] == len(HF.encode(t or "").ids) for i, (_, t) in enumerate(ODD)) and len(out) == len(ODD) + 1
    assert unigram.count_tokens(spark, odd_docs(spark).where("false"), PIECES).count() == 0
    assert sentencepiece.SentencePieceProcessor(model_file=PIECES).get_piece_size() == len(VOCAB)


def test_unigram_vocabularies_do_not_share_a_counter(spark):
    """Equal length and last entry; the worker keeps one counter for each vocabulary."""
    docs = spark.createDataFrame([(1, "az")], "doc_id long, text string").coalesce(1)
    one = [("▁", -1.0, "normal"), ("a", -1.0, "normal"), ("z", -1.0, "normal")]
    two = [("▁az", -1.0, "normal"), ("a", -1.0, "normal"), ("z", -1.0, "normal")]
    assert [unigram.count_tokens(spark, docs, v).first()["n_tokens"] for v in (one, two, one)] == [3, 1, 3]


def test_unigram_list_with_real_log_probabilities(spark, tmp_path):
    """A Unigram file: scores are log probabilities of counted pieces; the library's own counts are the standard."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeo") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(60)]
    seen: dict[str, int] = {}
    for t in texts:
        for w in t.split():
            w = "▁" + w
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + 5) + 1):
                    seen[w[i:j]] = seen.get(w[i:j], 0) + 1
    total = sum(seen.values())
    vocab = [("<unk>", 0.0)] + [(p, float(np.log(n / total))) for p, n in sorted(seen.items())]
    tokenizer = Tokenizer(models.Unigram(vocab, 0, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    tokenizer.save(f"{tmp_path}/unigram.json")
    docs = spark.createDataFrame([*enumerate([*texts, "zz a zz", ""])], "doc_id long, text string")
    out = {r["doc_id"]: r["n_tokens"] for r in unigram.count_tokens(spark, docs, unigram.read_unigram(f"{tmp_path}/unigram.json")).collect()}
    assert out == {i: len(tokenizer.encode(t).ids) for i, t in enumerate([*texts, "zz a zz", ""])}


ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


PARTS = ["password", "TOKEN", "api_key", "apikey", "Secret", "=", ":", " ", "  ", '"', "'", "abcdef0123456789", "0123", "AKIA", "ZZ99XX", "é", "\n", "token", "passwd", "-", "aaaaaaaa", "東", "x" * 9]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=24).map("".join))
def test_secret_spans_equal_regexes(text):
    assert [x for x in secrets.scanner().find(text) if x[1] < 3] == brute_spans(text)


def test_secrets_query_and_redaction(spark):
    key, token = "AKIA" + "Q" * 12, 'token = "' + "a1" * 20
    docs = spark.createDataFrame([(1, f"é {key} {token}", 9), (2, None, 0), (3, "clean text", 10), (None, "ghp_" + "A" * 36, 1), (3, "clean text", 10)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in secrets.find_secrets(spark, docs).collect()}
    assert (out[1]["n_assign"], out[1]["n_access"], out[1]["n_hex"]) == (1, 1, 1)
    assert out[1]["spans"].split(",")[0] == f"access:2:{2 + len(key)}"
    assert out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[None]["spans"] == "github:0:40"
    clean = {r["doc_id"]: r for r in secrets.redact_documents(docs).collect()}
    assert clean[1]["text"].startswith("é [ACCESS] [ASSIGN]") and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2]["text"] is None and clean[3]["text"] == "clean text"
    assert secrets.find_secrets(spark, docs.where("false")).count() == 0


def longest_spans(pattern, text):
    """Leftmost, then longest, non-overlapping matches by trying every begin and end."""
    out, i = [], 0
    while i < len(text):
        j = next((j for j in range(len(text), i, -1) if re.fullmatch(pattern, text[i:j])), None)
        if j:
            out.append((i, j))
        i = j or i + 1
    return out


PATTERNS = ["a(?:b|c){2,3}", "[^a]c+", "(?i:xy)?z", "ab*", "b{2}", "abcx|bc", "ab(?:c+x)?", "(?:ab)+c|b", "(?:a|b)*c(?:a|b)?", "b(?:.*c)?", "a{3,}"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PATTERNS), min_size=1, max_size=4, unique=True), st.text("abcxyzZ", max_size=14) | st.text("abc", max_size=14))
def test_automaton_equals_regexes(patterns, text):
    made = automaton.Automaton(patterns)
    want = sorted((i, k, j) for k, p in enumerate(patterns) for i, j in longest_spans(p, text))
    assert sorted(made.spans(text.encode())) == want
    assert sorted(pickle.loads(pickle.dumps(made)).spans(text.encode())) == want


def test_automaton_is_minimal_and_rejects_empty_matches():
    assert len(automaton.Automaton(["ab|cb"]).table) == len(automaton.Automaton(["[ac]b"]).table)
    with pytest.raises(ValueError):
        automaton.Automaton(["a*"])


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_corrects_and_carves():
    import gzip
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    gz, inner = gzip.compress(b"x" * 100), png()
    assert media.corrected(inner, "image/jpeg") == ("image/png", [])
    assert media.corrected(buffer.getvalue(), None)[0] == "application/zip"
    payload = b"BM not a bitmap " + inner + b"RIFF" + gz + b"%PDF-1.4 nothing"
    wave = media.to_wave(payload + b"\0" * (len(payload) & 1))
    kind, carved = media.corrected(wave, "text/plain")
    assert kind == "audio/wav" and [c[2] for c in carved] == ["image/png", "application/gzip"]
    assert all(wave[a : a + n] in (inner, gz) for a, n, _ in carved)
    broken = bytearray(inner)
    broken[20] ^= 1
    assert media.corrected(bytes(broken), "image/png") == ("image/png", []) and media.sniff(bytes(broken)) == []


def boxes(*parts):
    return b"".join(struct.pack(">I4s", 8 + len(body), name) + body for name, body in parts)


def ogg_page(flags, body, seq):
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, 0, 7, seq, 0) + bytes([1, len(body)])
    crc = 0
    for byte in head + body:  # bit by bit
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc >> 31 else 0)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def test_sniffing_of_containers():
    mp4 = boxes((b"ftyp", b"isom\0\0\0\0"), (b"moov", b"x" * 20), (b"mdat", b"y" * 9))
    ogg = ogg_page(2, b"first", 0) + ogg_page(4, b"last", 1)
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBP" + b"VP8L" + struct.pack("<I", 6) + b"abcdef"
    for data, kind in ((mp4, "video/mp4"), (ogg, "application/ogg"), (webp, "image/webp")):
        assert media.corrected(data, None) == (kind, [])
        assert media.corrected(b"text " + data + b" more text", "text/plain") == ("text/plain", [(5, len(data), kind)])
        assert media.sniff(data[:-1]) == []
    broken = bytearray(ogg)
    broken[-1] ^= 1
    assert media.sniff(bytes(broken)) == []


def test_false_magics_cost_no_second_search():
    import time

    def seconds(data):
        begin = time.process_time()
        assert media.sniff(data) == []
        return time.process_time() - begin

    for magic in (b"PK\x03\x04", b"%PDF-1", b"\xff\xd8\xff\xda\0\2", b"GIF89a", b"OggS\0\2", b"RIFF"):
        assert seconds(magic * 40_000) < 4


def test_stored_form_equals_the_standard_librarys():
    import io
    import wave

    for text in ("", "abc", "é" * 1000):
        payload, _ = media.to_payload(text)
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(media.RATE)
            w.writeframes(payload)
        row = media.describe(media.to_wave(payload), "application/octet-stream")
        assert row["media_sha256"] == hashlib.sha256(buffer.getvalue()).hexdigest() and row["media_bytes"] == len(buffer.getvalue())
        with wave.open(io.BytesIO(media.to_wave(payload))) as w:
            assert w.readframes(w.getnframes()) == payload
            assert row["feature"] == f"type=audio/wav;declared=application/octet-stream;samples={w.getnframes()};carved=0"


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=1500))
def test_media_round_trip(text):
    payload, n = media.to_payload(text)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[:n].decode() == text
    assert media.from_wave(media.to_wave(payload)) == payload


def test_media_query_on_odd_rows(spark):
    out = {r["doc_id"]: r for r in media.inspect_media(media.encode_media(odd_docs(spark))).collect()}
    for i, (_, t) in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert out[i]["n_bytes"] == len(raw) and out[i]["payload_bytes"] == len(payload)
        assert out[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and out[i]["tail_crc32"] == zlib.crc32(payload[-32:])
    assert out[2]["media_sha256"] == out[3]["media_sha256"] and len(out) == len(ODD) + 1


def test_pem_takes_the_whole_key():
    from kgspark.llm import secrets

    body = "\n".join(["MIIEpAIBAAKCAQEA7bq+/x" + "Qz9" * 14] * 4 + ["c2hvcnQ="])
    for kind in ("", "RSA ", "OPENSSH "):
        key = f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
        assert secrets.redact(f"a\n{key}\nb {key} c") == "a\n[PEM]\nb [PEM] c"
        assert secrets.redact("é " + key.replace("\n", "\\n") + '"') == 'é [PEM]"'
        assert secrets.redact(key.replace("KEY-----\n", "KEY-----\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,0AF3\r\n\r\n", 1)) == "[PEM]"
    cut = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(body.split("\n")[:3])
    assert secrets.redact(cut + "\nand prose, on and on") == "[PEM]\nand prose, on and on"
    assert secrets.redact("-----BEGIN PRIVATE KEY----- is how a key begins") == "[PEM] is how a key begins"


def test_toxicity_learns_and_ignores_language(spark):
    from kgspark.llm import toxicity

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de", None])))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", None), (902, rows[0][1], "xx"), (None, "x", None)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab, toxicity.Settings(epochs=8))
    out = {r["doc_id"]: r for r in toxicity.score_documents(spark, docs, model).collect()}
    held = [i for i in range(700) if out[i]["held_out"]]
    assert len(held) > 100 and all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(700))
    right = sum(out[i]["predicted"] == int(i % 5 == 0) for i in held) / len(held)
    assert right > 0.9
    assert out[902]["score"] == pytest.approx(out[0]["score"]) and out[900]["score"] == out[901]["score"] and len(out) == 704
    kept = toxicity.drop_toxic(spark, docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["rejected"]}
    twice = toxicity.train(docs.unionByName(docs), lab.unionByName(lab), toxicity.Settings(epochs=8))  # repeated rows are one row of the sample
    assert twice.out.tolist() == model.out.tolist()
    none = toxicity.train(docs, lab.where("false"))
    assert {r["predicted"] for r in toxicity.score_documents(spark, docs, none).collect()} == {0}
    assert toxicity.score_documents(spark, docs.where("false"), model).count() == 0


def test_toxicity_calibrates_on_all_labels_kept_from_the_fit(spark, monkeypatch):
    """A bounded sample for the fit; thresholds from every other label, with one for a language of few toxic rows."""
    from kgspark.llm import toxicity

    rng, rows, labels, seen = random.Random(5), [], [], []
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(100)]
    for i in range(1600):
        lang, toxic = ("fr" if i % 10 == 0 else "en"), i % 50 < 10
        rows.append((i, " ".join([*rng.choices(words, k=10), *(["idiot"] if toxic or rng.random() < 0.1 else [])]), lang))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    original = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda model, found, totals: (seen.append(found), original(model, found, totals)))
    s = toxicity.Settings(toxic_rows=40, clean_rows=80)
    model = toxicity.train(docs, lab, s)
    usable = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    n = {t: sum(r["n"] for r in seen[0].to_pylist() if r["toxic"] == t) for t in (0, 1)}
    assert n == {1: sum(t for _, t in usable) - 30, 0: sum(1 - t for _, t in usable) - 60}
    assert set(model.by_lang) == {"en", "fr"}
    z = {int(round(float(model.logits([toxicity._buckets(s.buckets)(text)])[0]) * s.steps)) for i, text, _ in rows if (i, 0) in usable or (i, 1) in usable}
    assert all(any(abs(r["bin"] - x) <= 1 for x in z) for r in seen[0].to_pylist())


def small_toxicity_model():
    from kgspark.llm import toxicity

    rng = np.random.default_rng(3)
    s = toxicity.Settings(buckets=1 << 12, least_texts=1, epochs=3)
    words = toxicity.WordBuckets(s.buckets)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 30))) + (" idiot moron" if i % 4 == 0 else "") for i in range(200)]
    y = np.array([i % 4 == 0 for i in range(200)], dtype=float)
    model, _ = toxicity.fit([words(t) for t in texts], y, np.ones(200), s)
    return model, words, texts


def test_toxicity_score_is_a_function_of_the_text():
    """Alone, first, last, in any order and beside any neighbour a text has the same bits."""
    model, words, texts = small_toxicity_model()
    docs = [words(t) for t in [*texts, "", "x", "idiot", "moron idiot", ""]]
    alone = [model.scores([d])[0] for d in docs]
    rng = random.Random(4)
    for _ in range(20):
        order = rng.sample(range(len(docs)), len(docs))
        at, got = 0, []
        while at < len(order):  # slices of any size
            n = rng.randrange(1, 60)
            got += model.scores([docs[i] for i in order[at : at + n]]).tolist()
            at += n
        assert got == [alone[i] for i in order]
    assert alone[-1] == alone[-5] < 0.3 < max(alone)


def test_toxicity_equals_a_forward_pass_by_loops():
    model, words, texts = small_toxicity_model()
    for text in [*texts[:40], "", "idiot", "a b"]:
        ids = [int(model.rows[w]) for w in words(text)]
        total = model.out_bias
        for k, (tables, bias) in enumerate(zip(model.tables, model.bias, strict=True)):
            padded = ids + [0] * max(len(tables), max(model.settings.widths))
            for f in range(len(bias)):
                best = max(sum(float(t[padded[i + o]][f]) for o, t in enumerate(tables)) for i in range(len(padded) - len(tables) + 1))
                total += max(best + float(bias[f]), 0.0) * float(model.out[k * len(bias) + f])
        assert model.logits([words(text)])[0] == pytest.approx(total, abs=1e-4)


def test_best_threshold_on_ties():
    from kgspark.llm.toxicity import best_threshold

    p, t = np.array([0.9, 0.9, 0.4, 0.4]), np.array([1, 1, 0, 1])
    assert best_threshold(p, t, np.ones(4)) == 0.2


def test_no_threshold_without_precision():
    """A model that cannot tell the classes apart rejects nothing."""
    from kgspark.llm.toxicity import best_threshold

    rng = np.random.default_rng(50)
    p, t = rng.random(400), (np.arange(400) % 5 == 0).astype(float)
    assert best_threshold(np.full(400, 0.6), t, np.ones(400)) > 1
    assert best_threshold(np.where(t == 1, 0.9, p * 0.5), t, np.ones(400)) < 0.9


def test_media_of_an_empty_table(spark):
    assert media.inspect_media(media.encode_media(odd_docs(spark).where("false"))).count() == 0
