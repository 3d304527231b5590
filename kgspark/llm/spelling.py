"""Spelling variants: words one edit apart, found through a positional q-gram index with a count filter.

Words are counted over all texts. Two words are near if one inserted, deleted or
replaced code point turns one into the other. The index is held in shards: one
edit leaves either the first or the second half of the longer word whole, so a
word of ``L`` letters is sent, once as the longer (``M = L``) and once as the
shorter of a pair (``M = L + 1``), to the shard of its head and to that of its
tail. A shard with more than ``most`` words is split: the part of the word that
holds the edit is halved, and the key takes one half more, until it holds at most
``most`` words or all but one letter (then the alphabet bounds it). So no task
holds more than a bounded shard, and no pair is lost.

Within a shard, the postings of every positional q-gram outside the shared key are
merged by a heap; only postings of the right length and position are in one list.
An edit destroys at most ``q`` grams, so words that share fewer than
``M - q + 1 - q`` are dropped; the rest are verified. A pair is reported only by
the shard whose part holds its first difference, so it comes once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.runtime import discard, materialize

from .common import groups, relax
from .words import LATIN, PIECE, utf8

#: Words have so many code points at least, and occur so often.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as common as its variant.
TIMES = 5
#: Every 199th hash of document and run loses a letter (the typing errors of the contract).
TYPO = 199
#: Letters of a gram.
Q = 2
#: Words of a shard.
MOST = 2000
#: Distinct words held in a worker before they are sent on.
HELD = 400_000


def typed(run: bytes, doc: bytes, typo: int) -> bytes:
    """The run (Latin-1, lower case) as it counts: without one letter if the hash of document and run says so."""
    text = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(text, zlib.crc32(doc))
    if h % typo:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _latin(text: str) -> Iterator[list[bytes]]:
    """Words of a text in pieces, as Latin-1; code points beyond it separate words."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + PIECE) if at + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].encode("latin-1", "replace").translate(LATIN).split()
        at = end


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """word, n of every word that is long and common enough; summed in the workers first."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text")).where("text is not null")

    def sums(n: Counter) -> Iterator[pa.RecordBatch]:
        words = list(n)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([utf8([w if w.isascii() else w.decode("latin-1").encode() for w in part]), pa.array([n[w] for w in part], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    head = doc.encode() + b":"
                    for words in _latin(text):
                        for w, times in Counter([w for w in words if len(w) >= least_length]).items():
                            found = typed(w, head, typo)
                            if len(found) >= least_length:
                                held[found] += times
                if len(held) > HELD:
                    yield from sums(held)
                    held.clear()
        yield from sums(held)
        held.clear()
        relax()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one word into the other."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    p = first_difference(a, b)
    return a[p + 1 :] == (b[p + 1 :] if len(a) == len(b) else b[p:])


def first_difference(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def near_in_shard(words: list[str], m: int, low: int, high: int, q: int = Q) -> Iterator[tuple[int, int]]:
    """Pairs of places of near words: ``a`` of ``m`` letters and ``b`` of ``m`` or ``m - 1``.

    All words share the first ``low`` letters and the last ``m - high``; the
    edit lies between. Grams inside these are in every word, so they are
    counted, not merged.
    """
    shared = max(0, low - q + 1) + max(0, m - high - q + 1)
    need = m - q + 1 - q - shared
    longer = [i for i, w in enumerate(words) if len(w) == m]
    if not longer:
        return
    if need <= 0:  # two letters at most are free, so the alphabet bounds the shard
        candidates = ((a, b) for a in longer for b in range(len(words)) if len(words[b]) < m or b > a)
    else:
        places = range(max(0, low - q + 1), min(m - q + 1, high))
        postings: dict[tuple[int, int, str], list[int]] = {}
        for i, w in enumerate(words):
            short = m - len(w)
            for p in range(max(0, places.start - short), min(places.stop, len(w) - q + 1)):
                postings.setdefault((short, p, w[p : p + q]), []).append(i)
        candidates = _merged(words, longer, m, places, postings, need, q)
    for a, b in candidates:
        if one_edit(words[a], words[b]) and low <= first_difference(words[a], words[b]) < high:
            yield a, b


def _merged(words: list[str], longer: list[int], m: int, places: range, postings: dict[tuple[int, int, str], list[int]], need: int, q: int) -> Iterator[tuple[int, int]]:
    none: list[int] = []
    for a in longer:
        w = words[a]
        lists = []
        for p in places:
            gram = w[p : p + q]
            for key in ((0, p, gram), (1, p, gram), (1, p - 1, gram)):  # a word with one letter less has its later grams one place before
                if len(found := postings.get(key, none)) > (key[0] == 0):
                    lists.append(found)
        last, times = -1, 0
        for b in merge(*lists):
            if b != last:
                if times >= need and (len(words[last]) < m or last > a):
                    yield a, last
                last, times = b, 0
            times += 1
        if times >= need and (len(words[last]) < m or last > a):
            yield a, last


def shards(words: DataFrame, most: int, scratch: list[DataFrame]) -> DataFrame:
    """word, n, m, low, high, key: every word in the shards where a near word can be, none with more than ``most`` words unless one letter is left."""
    halves = F.expr("explode(array(struct(cast(m / 2 as int) AS low, high), struct(low, cast(m / 2 as int) AS high)))")
    whole = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m"), F.lit(0).alias("low")).withColumn("high", F.col("m"))
    open_ = _keyed(whole.select("word", "n", "m", halves.alias("part")).select("word", "n", "m", "part.low", "part.high"))
    done = []
    while True:
        held = materialize(open_, "spelling-shards")
        full = held.where("high - low > 1").groupBy("key").count().where(F.col("count") > most).select("key")
        full = materialize(full, "spelling-full")
        scratch += [held, full]
        if full.isEmpty():
            return _union([*done, held])
        done.append(held.join(full, "key", "left_anti").select(*held.columns))
        split = F.expr("explode(array(struct(cast((low + high) / 2 as int) AS low, high), struct(low, cast((low + high) / 2 as int) AS high)))")
        again = held.join(full, "key", "left_semi").select("word", "n", "m", split.alias("part"))
        open_ = _keyed(again.select("word", "n", "m", "part.low", "part.high"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The key: lengths, and the letters before ``low`` and after ``high`` (places in the longer word)."""
    tail = F.expr("right(word, m - high)")
    head = F.expr("left(word, low)")
    return rows.withColumn("key", F.concat_ws(",", "m", "low", "high", head, tail))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_pairs(words: DataFrame, most: int = MOST, scratch: list[DataFrame] | None = None) -> DataFrame:
    """word, n, near, near_n: every pair of near words, once from each side. Words have at least two letters and are distinct.

    ``scratch`` gets the tables that the result reads.
    """
    dealt = shards(words, most, scratch if scratch is not None else []).repartition("key").sortWithinPartitions("key")
    names = ["word", "n", "near", "near_n"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, int]] = []
        for g in groups(batches, ["key"]):
            if len(g["word"]) == 1:
                continue
            w, n = g["word"], g["n"]
            for a, b in near_in_shard(w, g["m"][0], g["low"][0], g["high"][0]):
                out += [(w[a], n[a], w[b], n[b]), (w[b], n[b], w[a], n[a])]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        relax()

    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def variants(docs: DataFrame, times: int = TIMES, most: int = MOST, typo: int = TYPO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every common word of the texts.

    ``form``: the near word of largest ``n`` (ties: first in code-point order)
    if that is at least ``times`` the word's; else null. ``root``: the end of
    the chain of forms, the word itself without one; counts rise by ``times``
    at each step, so chains are short and end. Null and empty texts have no
    words, a null id counts as an empty one, repeated rows count again, very
    long texts are read in pieces, an empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    words = materialize(word_counts(docs, typo=typo), "spelling-words")
    # UTF-8 order is code-point order
    scratch: list[DataFrame] = []
    best = near_pairs(words, most, scratch).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("up"))
    formed = materialize(found.select("word", "up.form", "n", "n_near", "up.form_n"), "spelling-forms")
    discard(words, *scratch)
    links = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # each round doubles the steps taken
        up = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(up, "root", "left_semi").isEmpty():
            break
        further = materialize(links.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        discard(links)
        links = further
    out = formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialize(out, "spelling")
    discard(formed, links)
    return out
