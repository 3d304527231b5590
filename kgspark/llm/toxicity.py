"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to embedding rows, one for each hash value that at least a few
sampled texts hold (all others share the padding row); filters of several widths slide over the
text; each filter's largest value feeds a logistic output. Training runs on the
driver over a bounded, stratified sample of labelled rows. For scoring, the
product of the embedding table with each filter slice is taken once, so a text
costs a few table rows and sums for each word, wherever it lies in the text.

Scores are calibrated on all labelled rows kept from training, in and outside the
sample: they are scored in Spark, and histograms of their logits give a logistic
map for the score and for each language the threshold of the best F1.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.runtime import materialize

from . import common

WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Settings:
    """Bounds and sizes. ``toxic_rows``, ``clean_rows`` and ``text_words`` bound the labelled sample that the fit reads."""

    toxic_rows: int = 3000
    clean_rows: int = 5000
    #: Longer texts are scored and calibrated on like all others, but not fitted on.
    text_words: int = 25_000
    #: Hash values, and sampled texts that must hold one for it to have a row of its own (rarer words are padding).
    buckets: int = 1 << 20
    least_texts: int = 3
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    batch: int = 48
    rate: float = 0.01
    #: Step of the embeddings, smaller since each row has few texts.
    rate_rows: float = 0.003
    shrink: float = 4.0
    seed: int = 11
    #: Steps of a unit of the logit in the histograms of the calibration.
    steps: int = 256


class WordBuckets:
    """Words to embedding rows 1.. (0 is padding), remembered up to a bound."""

    def __init__(self, buckets: int, most: int = 300_000) -> None:
        self.buckets, self.most = buckets, most
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> list[int]:
        known, words = self.known, WORDS(text.lower())
        if len(known) > self.most:
            known.clear()
        out = [known.get(w) for w in words]
        for i, b in enumerate(out):
            if b is None:
                w = words[i]
                out[i] = known[w] = 1 + zlib.crc32(w.encode()) % (self.buckets - 1)
        return out


def padded(docs: list, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array with ``gap`` padding ids after each document, and where each begins."""
    sizes = np.array([len(d) + gap for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.zeros(starts[-1] + gap, dtype=np.int64)
    for d, at in zip(docs, starts[:-1].tolist(), strict=True):
        flat[at : at + len(d)] = d
    return flat, starts


@dataclass
class Model:
    settings: Settings
    #: For each width, the embedding table times each slice of its filters.
    tables: list[list[np.ndarray]]
    #: Row of each hash value.
    rows: np.ndarray
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    #: Slope and offset of the calibrated score.
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)

    def logits(self, docs: list) -> np.ndarray:
        s = self.settings
        gap = max(s.widths)
        flat, starts = padded(docs, gap)
        flat = self.rows[flat]
        ends, pooled = len(flat) - gap, []
        for tables, bias in zip(self.tables, self.bias, strict=True):
            z = tables[0][flat[:ends]]
            for o in range(1, len(tables)):
                z += tables[o][flat[o : ends + o]]
            for o in range(1, len(tables)):
                z[starts[1:] - o] = -np.inf  # these windows would reach into the next text
            pooled.append(np.maximum(np.maximum.reduceat(z, starts[:-1], axis=0) + bias, 0))
        return (np.concatenate(pooled, axis=1) * self.out).sum(axis=1) + self.out_bias

    def scores(self, docs: list) -> np.ndarray:
        """Between 0 and 1, each a function of its own text: no window crosses two texts."""
        x = self.logits(docs).astype(np.float64) * self.scale[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def constant(settings: Settings, rate: float) -> Model:
    """The model without labels of both kinds: the share of toxic labels as every score, and nothing rejected."""
    n = settings.filters * len(settings.widths)
    tables = [[np.zeros((1, settings.filters), np.float32) for _ in range(w)] for w in settings.widths]
    p = min(max(rate, 1e-3), 0.25)
    return Model(settings, tables, np.zeros(settings.buckets, np.int32), [np.zeros(settings.filters, np.float32) for _ in settings.widths], np.zeros(n, np.float32), float(np.log(p / (1 - p))))


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float, rate_rows: float) -> None:
        self.params, self.rate, self.rate_rows, self.t = params, rate, rate_rows, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray], rows: np.ndarray) -> None:
        """The first parameter is a table, of which only ``rows`` have gradients; its other rows wait."""
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for i, g in enumerate(grads):
            at = rows if i == 0 else slice(None)
            m = self.m[i][at] + 0.1 * (g - self.m[i][at])
            v = self.v[i][at] + 0.001 * (g * g - self.v[i][at])
            self.m[i][at], self.v[i][at] = m, v
            self.params[i][at] -= (self.rate_rows if i == 0 else self.rate) * fix * m / (np.sqrt(v) + 1e-8)


def _log_odds(docs: list, y: np.ndarray, weight: np.ndarray, s: Settings, n: int) -> np.ndarray:
    """Shrunken log odds of the classes by presence of a word."""
    counts = np.zeros((2, n))
    for d, label, w in zip(docs, y, weight, strict=True):
        counts[int(label), np.unique(np.asarray(d, dtype=np.int64))] += w
    base = weight[y == 1].sum() / weight.sum()
    odds = np.log((counts[1] + s.shrink * base) / (counts[0] + s.shrink * (1 - base))) - np.log(base / (1 - base))
    odds[0] = 0
    return np.clip(odds, -1, 4).astype(np.float32)


def fit(docs: list, y: np.ndarray, weight: np.ndarray, s: Settings) -> tuple[Model, list[int]]:
    """Train on three quarters of the rows, and which these are. ``weight``: rows each row stands for."""
    y = np.asarray(y, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return constant(s, float(y.mean()) if len(y) else 0.1), []
    texts = np.bincount(np.concatenate([np.unique(np.asarray(d, dtype=np.int64)) for d in docs]), minlength=s.buckets)
    texts[0] = 0
    rows = np.where(texts >= s.least_texts, np.cumsum(texts >= s.least_texts), 0).astype(np.int32)
    docs, n_rows = [rows[np.asarray(d, dtype=np.int64)] for d in docs], int(rows.max()) + 1
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    held = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        own = order[y[order] == label]
        held[own[: len(own) // 4]] = True
    train = [i for i in order if not held[i]]
    if y[train].min() == y[train].max():
        held[:], train = False, list(order)

    odds = _log_odds([docs[i] for i in train], y[train], weight[train], s, n_rows)
    emb = (rng.standard_normal((n_rows, s.dim)) * 0.1).astype(np.float32)
    emb[:, 0] = odds
    emb[0] = 0
    filters = [(rng.standard_normal((w, s.dim, s.filters)) * 0.15).astype(np.float32) for w in s.widths]
    for f in filters:
        f[:, 0, : s.filters // 2] += 0.5
    bias = [np.zeros(s.filters, np.float32) for _ in s.widths]
    out = np.full(s.filters * len(s.widths), 0.2, np.float32)
    out_bias = np.array([np.log(y.mean() / (1 - y.mean()))], np.float32)
    params = [emb, *filters, *bias, out, out_bias]
    adam = _Adam(params, s.rate, s.rate_rows)
    gap, nw = max(s.widths), len(s.widths)
    for _ in range(s.epochs):
        train = [train[i] for i in rng.permutation(len(train))]
        for at in range(0, len(train), s.batch):
            part = train[at : at + s.batch]
            flat, starts = padded([docs[i] for i in part], gap)
            ends = len(flat) - gap
            x = emb[flat]
            pooled, where = [], []
            for f, b in zip(filters, bias, strict=True):
                z = x[:ends] @ f[0]
                for o in range(1, len(f)):
                    z += x[o : ends + o] @ f[o]
                best = np.stack([starts[k] + z[starts[k] : starts[k + 1] - len(f) + 1].argmax(axis=0) for k in range(len(part))])
                where.append(best)
                pooled.append(np.take_along_axis(z, best, axis=0) + b)
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            keep = (rng.random(hidden.shape) > 0.2).astype(np.float32) / 0.8
            p = 1 / (1 + np.exp(-np.clip((hidden * keep) @ out + out_bias[0], -30, 30)))
            g = ((p - y[part]) / len(part)).astype(np.float32)
            touched: list[np.ndarray] = []
            moves: list[np.ndarray] = []
            grads = [np.zeros_like(q) for q in params[1:]]
            grads[-1][0] = g.sum()
            grads[-2][:] = (hidden * keep).T @ g + 1e-4 * out
            up = g[:, None] * out[None, :] * keep * (raw > 0)
            for k, (f, best) in enumerate(zip(filters, where, strict=True)):
                own = up[:, k * s.filters : (k + 1) * s.filters]
                grads[nw + k][:] = own.sum(axis=0)
                for o in range(len(f)):
                    at_pos = best + o
                    grads[k][o] = np.einsum("df,dfe->ef", own, x[at_pos])
                    touched.append(flat[at_pos].reshape(-1))
                    moves.append((own[:, :, None] * f[o].T[None, :, :]).reshape(-1, s.dim))
            rows_hit, where_hit = np.unique(np.concatenate(touched), return_inverse=True)
            row_grads = np.zeros((len(rows_hit), s.dim), np.float32)
            np.add.at(row_grads, where_hit, np.concatenate(moves))
            row_grads[rows_hit == 0] = 0
            adam.step([row_grads, *grads], rows_hit)
    tables = [[(emb @ f[o]).astype(np.float32) for o in range(len(f))] for f in filters]
    return Model(s, tables, rows, bias, out, float(out_bias[0])), train


def histogram(texts: DataFrame, rows: DataFrame, model: Model, used: np.ndarray) -> pa.Table:
    """``lang, bin, toxic, n``: logits of all labelled documents but those of the keys in ``used``, which the fit bounds."""
    spark, steps = texts.sparkSession, model.settings.steps
    shared = common.broadcast(spark, (model, np.sort(used), common.bitmap(rows.select(F.xxhash64("key").alias("key")))))

    def run(cols: dict[str, list]) -> dict[str, list]:
        m, fitted, bits = shared.value
        may = common.maybe(bits, np.array(cols["hash"], dtype=np.int64).view(np.uint64)) & ~np.isin(cols["key"], fitted)
        keep = np.flatnonzero(may).tolist()
        z = np.array(_by_chunks(m, m.logits, [cols["text"][i] for i in keep]), dtype=np.float64)
        return {"key": [cols["key"][i] for i in keep], "lang": [cols["lang"][i] or "" for i in keep], "bin": np.rint(np.clip(z, -40, 40) * steps).astype(np.int32)}

    able = texts.where(f"key is not null and {common.crc_text('key')} % 4 <> 2").select("key", F.xxhash64("key").alias("hash"), "lang", "text")
    scored = common.map_batches(able, run, "key long, lang string, bin int")
    found = scored.join(rows, "key").groupBy("lang", "bin", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "bin", "toxic").toArrow()
    shared.destroy()
    return found


def calibrate(model: Model, found: pa.Table, totals: dict[int, int]) -> None:
    """Logistic map of the logits by weighted likelihood, then thresholds of the best weighted F1.

    ``totals``: labelled rows of each class, for which the rows of ``found`` stand.
    A language without a toxic row has no F1 and uses the common threshold.
    """
    z, t = found.column("bin").to_numpy() / model.settings.steps, found.column("toxic").to_numpy().astype(np.float64)
    n = found.column("n").to_numpy().astype(np.float64)
    w = n * np.where(t == 1, totals[1] / n[t == 1].sum(), totals[0] / n[t == 0].sum())
    w /= w.sum()
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, h = w * (p - t), w * p * (1 - p) + 1e-9
        grad = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    model.scale = float(max(a, 0.05)), float(b)
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + b, -40, 40)))
    model.threshold = best_threshold(p, t, w)
    names = np.array(found.column("lang").to_pylist())
    for name in sorted(set(names.tolist())):
        own = names == name
        if t[own].any():
            model.by_lang[name] = best_threshold(p[own], t[own], w[own])


#: Weighted precision that a threshold needs; without a cut that has it nothing is rejected.
LEAST_PRECISION = 0.5
NOTHING = 1.01


def best_threshold(p: np.ndarray, t: np.ndarray, w: np.ndarray) -> float:
    """The cut with the highest weighted F1 among those of ``LEAST_PRECISION``, midway to the next lower score and within [0.2, 0.8]: outside, small samples decide.

    ``NOTHING`` if no cut is that precise: a model that cannot tell must not empty the corpus.
    """
    order = np.argsort(-p, kind="stable")
    hit, cut = np.cumsum((w * t)[order]), np.cumsum(w[order])
    f1 = 2 * hit / (cut + (w * t).sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    f1[hit < LEAST_PRECISION * cut] = -1
    k = int(f1.argmax())
    if f1[k] <= 0:
        return NOTHING
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return min(max(0.2, float(p[order][k] + below) / 2), 0.8)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id") -> Model:
    """Fit on a bounded sample of labelled rows, calibrated on all others; the same for the same data.

    Learns only from rows whose crc32(id as text) mod 4 is not 2. Repeated labels
    of a document count once, toxic if any is. Null ids and null labels are left out.
    Of documents that repeat a sampled id one text is fitted on (the least hash).
    """
    model = _train(docs, labels, settings, id_col)
    common.relax()  # the sample and the arrays of the fit are not needed any more
    return model


def _train(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str) -> Model:
    rows = labels.where(f"doc_id is not null and toxic is not null and {common.crc_text('doc_id')} % 4 <> 2").groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = materialize(rows, "toxicity-labels")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pick = lambda label, n: rows.where(F.col("toxic") == label).orderBy(F.xxhash64("key"), "key").limit(n)
    sample = pick(1, settings.toxic_rows).unionByName(pick(0, settings.clean_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    joined = texts.join(F.broadcast(sample), "key").groupBy("key", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # bounded by the two sample sizes

    def tokens(cols: dict[str, list]) -> dict[str, list]:
        words = _buckets(settings.buckets)
        return {"key": cols["key"], "toxic": cols["toxic"], "ids": [words(t or "") for t in cols["text"]]}

    found = common.map_batches(joined.select("key", "toxic", "text"), tokens, "key long, toxic int, ids array<int>").where(F.size("ids") <= settings.text_words).toArrow()
    ids = [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) for x in found.column("ids")]
    y, keys = found.column("toxic").to_numpy(), found.column("key").to_numpy()
    order = np.lexsort([[len(i) for i in ids], keys]) if len(keys) else []
    kept = {label: max(1, int((y == label).sum())) for label in (0, 1)}
    weight = np.array([totals.get(int(v), 0) / kept[int(v)] for v in y], dtype=np.float64)
    if not len(y):
        return fit([], y, weight, settings)[0]
    model, used = fit([ids[i] for i in order], y[order], weight[order], settings)
    if used:
        seen = histogram(texts, rows, model, keys[order][used])
        if len(set(seen.column("toxic").to_pylist())) < 2:  # too few labels to keep some of both kinds from the fit
            seen = histogram(texts, rows, model, np.array([], dtype=np.int64))
        calibrate(model, seen, totals)
    return model


_BUCKETS: dict[int, WordBuckets] = {}


def _buckets(n: int) -> WordBuckets:
    return _BUCKETS.setdefault(n, WordBuckets(n))


#: Words scored at once inside a worker; bounds memory, not input.
CHUNK_WORDS = 200_000


def _by_chunks(model: Model, of, texts: list) -> list[float]:  # noqa: ANN001
    words, out, held, size = _buckets(model.settings.buckets), [], [], 0
    for t in texts:
        held.append(words(t or ""))
        size += len(held[-1])
        if size >= CHUNK_WORDS:
            out += of(held).tolist()
            held, size = [], 0
    return out + (of(held).tolist() if held else [])


def _score_texts(model: Model, texts: list) -> list[float]:
    return _by_chunks(model, model.scores, texts)


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, cut: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """Score of every document: ``doc_id, held_out, score, predicted, rejected``.

    ``predicted`` is score >= ``cut``; ``rejected`` uses the threshold calibrated
    for the row's language, which never enters the score. Null and empty texts
    are scored as padding only. One row for each row in, repeated rows included,
    null ids pass through, very long texts are read whole, and an empty table gives
    no rows. Other columns are not carried, so their names cannot clash.
    """
    held = common.broadcast(spark, model)

    def run(cols: dict[str, list]) -> dict[str, list]:
        m = held.value
        s = _score_texts(m, cols["text"])
        return {
            "doc_id": cols["doc_id"],
            "held_out": cols["held_out"],
            "score": s,
            "predicted": [int(x >= cut) for x in s],
            "rejected": [x >= m.by_lang.get(lang or "", m.threshold) for x, lang in zip(s, cols["lang"], strict=True)],
        }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(f"{common.crc_text(id_col)} % 4 = 2").alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return common.map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int, rejected boolean")


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the calibrated thresholds reject; columns as they are.

    Null and empty texts are scored as padding, null languages by the common
    threshold. Equal texts of a language fare alike. Ids are not looked at, so
    null and repeated ones pass; an empty table stays empty.
    """
    held = common.broadcast(spark, model)

    def run(cols: dict[str, list]) -> dict[str, list]:
        m = held.value
        s = _score_texts(m, cols["text"])
        keep = [i for i, (x, lang) in enumerate(zip(s, cols["lang"], strict=True)) if x < m.by_lang.get(lang or "", m.threshold)]
        return {c: [v[i] for i in keep] for c, v in cols.items()}

    return common.map_batches(docs, run, docs.schema)
