"""URL filter: ratio of two smoothed variable-order Markov models over characters.

One model is fitted on URLs that rules accept, one on URLs that they reject. A
character's probability is that of its longest context seen in training, mixed
with the shorter ones by Witten-Bell weights down to a uniform alphabet. A URL
is kept when the difference of the two log-likelihoods, divided by its length,
reaches a threshold calibrated on labelled URLs kept from training.

Everything runs on DataFrame functions. Characters fold into an alphabet of 32
symbols, so the models have at most 32**(order+1) cells whatever the corpus
size; that bounded table is fitted by one aggregation, and enters the scoring
expression as one array literal: scoring needs no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = 32
#: Folded alphabet: 0 start and unknown, letters 1-26, 27 digits, 28 dot, 29 slash, 30 dash and underscore, 31 other marks of URLs.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Characters of the other classes (fixed values).
DIGITS, DOT, SLASH, DASH, MARKS = "0123456789", ".", "/", "-_", "?&=#%:+~@"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules: host suffix, path prefix, verdict (fixed values).
RULES = (Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = _rest(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), LETTERS.upper(), LETTERS), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for fit, r in reversed(list(zip(fits, ordered, strict=True))):
        name, verdict = F.when(fit, r.name).otherwise(name), F.when(fit, r.allow).otherwise(verdict)
    return name, verdict


def codes(url: Column, order: int) -> Column:
    """Array of window codes, one for each character: its symbol and the ``order`` before it, base 32.

    The windows come from shifted copies of the symbol array, so the work is
    linear in the length.
    """
    source = LETTERS + LETTERS.upper() + DIGITS + DOT + SLASH + DASH + MARKS
    # symbol k becomes the character with code 64 + k
    chars = LETTERS + LETTERS + chr(96 - 5) * len(DIGITS) + chr(92) + chr(93) + chr(94) * len(DASH) + chr(95) * len(MARKS)
    target = "".join(chr(64 + 1 + LETTERS.index(c)) if c in LETTERS else c for c in chars[: 2 * len(LETTERS)]) + chars[2 * len(LETTERS) :]
    known = "".join(sorted(set(source)))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "[^" + "".join("\\" + c if not c.isalnum() else c for c in known) + "]", "\x7f")
    folded = F.translate(clean, source + "\x7f", target + "@")
    symbols = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    code = symbols
    for back in range(1, order + 1):
        shifted = F.concat(F.array_repeat(F.lit(0), back), symbols)
        code = F.zip_with(code, F.slice(shifted, 1, F.size(symbols)), _scaled(SYMBOLS**back))
    return code


def _scaled(factor: int) -> Callable[[Column, Column], Column]:
    return lambda x, y: x + y * factor


def witten_bell(counts: np.ndarray, order: int) -> np.ndarray:
    """log P(symbol | window) for every window of ``order`` + 1 symbols.

    ``counts``: of full windows. Shorter windows are sums over the older symbols.
    A context with n symbols of t kinds gives the shorter context's estimate the
    weight t / (n + t); an unseen context passes it on unchanged.
    """
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(order + 1):
        c = counts.reshape(-1, SYMBOLS ** (k + 1)).sum(axis=0).reshape(-1, SYMBOLS)
        n, t = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (len(c) // max(1, p.size // SYMBOLS), 1))
        p = np.where(n > 0, (c + t * lower) / np.maximum(n + t, 1), lower)
    return np.log(p).reshape(-1)


@dataclass
class RatioModel:
    order: int
    ratio: np.ndarray  # accepted minus rejected log-probability of each window
    threshold: float

    def literal(self) -> Column:
        """The table as one constant array of integers in millionths: exact sums, whatever their order."""
        text = ",".join(map(str, np.rint(self.ratio * 1e6).astype(np.int64).tolist()))
        return F.split(F.lit(text), ",").cast("array<int>")

    def score(self, url: Column) -> Column:
        """Length-normalised log-likelihood difference; 0 for an empty URL."""
        table = self.literal()
        total = F.aggregate(codes(url, self.order), F.lit(0).cast("long"), lambda s, w: s + F.element_at(table, w + 1))
        return F.round(total / F.lit(1e6) / F.greatest(F.length(F.coalesce(url, F.lit(""))), F.lit(1)), 9)


def _window_counts(labelled: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of windows over accepted and rejected URLs: at most 32**(order+1) groups reach the driver."""
    rows = (
        labelled.select(F.col("accepted"), F.explode(codes(F.col("url"), order)).alias("w"))
        .groupBy("w")
        .agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
        .collect()
    )
    yes, no = np.zeros(SYMBOLS ** (order + 1)), np.zeros(SYMBOLS ** (order + 1))
    for r in rows:
        yes[r["w"]], no[r["w"]] = r["yes"], r["no"]
    return yes, no


def calibrated_threshold(hist: list[tuple[int, int, int]]) -> float:
    """Cut between score bins (in thousandths) with the highest balanced accuracy; the cut nearest 0 on ties."""
    yes, no = sum(h[1] for h in hist), sum(h[2] for h in hist)
    if not yes or not no:
        return 0.0
    best, cut, above, below = 0.5, 0, yes, 0
    found = []
    for b, y, n in sorted(hist):
        found.append(((above / yes + below / no) / 2, b))
        above, below = above - y, below + n
    best = max(q for q, _ in found)
    cut = min((b for q, b in found if q == best), key=lambda b: (abs(b), b))
    return cut / 1000


def fit(urls: DataFrame, order: int = 2) -> RatioModel:
    """``urls``: (url, accepted boolean or null). Every fifth labelled URL, by hash, calibrates; the rest train.

    Null URLs and rows without a label teach nothing. With only one kind of
    label the ratio is 0 everywhere and every URL is kept.
    """
    labelled = urls.where("url is not null and accepted is not null")
    calibrates = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    yes, no = _window_counts(labelled.where(~calibrates), order)
    ratio = witten_bell(yes, order) - witten_bell(no, order) if yes.any() and no.any() else np.zeros(SYMBOLS ** (order + 1))
    model = RatioModel(order, ratio, 0.0)
    bins = F.floor(model.score(F.col("url")) * 1000).cast("int")
    # log-ratios of smoothed counts are bounded, so are the bins
    hist = labelled.where(calibrates).groupBy(bins.alias("b")).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")).collect()
    model.threshold = calibrated_threshold([(r["b"], r["yes"], r["no"]) for r in hist])
    return model


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on every row: ``page_id, host, path, rule, verdict, score, threshold``.

    The longest fitting rule decides; else the model, fitted on the rows that
    rules decide. Null URLs and URLs without ``://`` have empty host and path and
    are judged by the model (a null URL as the empty text, score 0). Null ids,
    repeated rows and an empty table pass through; other columns are not carried,
    so their names cannot clash. Very long URLs are read whole.
    """
    url = F.col("url")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = base.withColumns({"host": host_of(url), "path": path_of(url)})
    name, allowed = best_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "accepted": allowed})
    model = fit(base.select("url", "accepted"), order)
    kept = F.coalesce(F.col("accepted"), F.col("score") >= model.threshold)
    return base.withColumn("score", model.score(url)).select("page_id", "host", "path", "rule", F.when(kept, "allow").otherwise("block").alias("verdict"), "score", F.lit(model.threshold).alias("threshold"))
