"""Benchmark decontamination: documents that hold windows of test items.

Texts are read as words joined by one blank. The hashes of all windows of a text
come from one cumulative sum over its bytes (a polynomial modulo 2^64), and are
looked up in the hashes of the items' windows; every hit is compared with the
item's text before it counts.

A benchmark within ``most_bytes`` and ``most_words`` is broadcast: its words once,
one hash a distinct window, and the items of each window. A larger one is not:
then a bitmap of fixed size of the windows' hashes is broadcast, and the windows
of documents that it lets pass are shuffled to the windows of the benchmark. Both
ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgspark.runtime import materialize

from .common import arrow_schema, bitmap, broadcast, maybe, relax
from .words import WORDS, binary, pieces

#: Words of a window.
SIZE = 10
#: Bounds of what is broadcast: bytes of the items' texts, and their words.
MOST_BYTES, MOST_WORDS = 32 << 20, 4_000_000
#: Words hashed at once.
BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
SCANNED = "n_words long, n_hit long, hits array<struct<first:int,last:int>>, items array<string>"


def normal(text: bytes | None) -> bytes:
    """The words of a text, joined by one blank."""
    return b" ".join(b" ".join(words) for words in pieces(text or b"", WORDS) if words)


def bounds(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    if not norm:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(norm)]])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(n, base, dtype=np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def hashes(norm: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch of bytes; starts and ends ascend."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), BLOCK):
        s, e = starts[at : at + BLOCK], ends[at : at + BLOCK]
        low, high = int(s[0]), int(e[-1])
        power, inverse = _powers(max(1 << 16, 1 << (high - low + 1).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(np.frombuffer(norm, np.uint8, high - low, low).astype(np.uint64) * power[: high - low], out=sums[1:])
        h = (sums[e - low] - sums[s - low]) * inverse[s - low]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[at : at + BLOCK] = h ^ (h >> np.uint64(29))
    return out


def windows(norm: bytes, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of an item: words of each, starts, ends, hashes. A short item is one window; one without words has none."""
    starts, ends = bounds(norm)
    k = min(size, len(starts))
    if k:
        s, e = starts[: len(starts) - k + 1], ends[k - 1 :]
        yield k, s, e, hashes(norm, s, e)


class Index:
    """All windows of a bounded benchmark: hashes sorted, where each stands in the items' words, and the items of each."""

    def __init__(self, rows: list[tuple[str, bytes]], size: int) -> None:
        self.names = sorted({name for name, _ in rows})
        number = {name: i for i, name in enumerate(self.names)}
        texts: list[bytes] = []
        found: dict[int, list[np.ndarray]] = {}
        base = 0
        for name, text in rows:
            norm = normal(text)
            for k, s, e, h in windows(norm, size):
                found.setdefault(k, []).append(np.stack([h, (s + base).astype(np.uint64), (e - s).astype(np.uint64), np.full(len(s), number[name], np.uint64)]))
            texts.append(norm)
            base += len(norm)
        self.text = b"".join(texts)
        self.parts = {k: self._part(np.concatenate(v, axis=1)) for k, v in found.items()}

    def _part(self, cols: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct windows by hash and bytes, each with the numbers of its items (``items[edge[i]:edge[i + 1]]``)."""
        cols = cols[:, np.argsort(cols[0], kind="stable")]
        window: dict[tuple[int, bytes], int] = {}
        of = np.empty(cols.shape[1], np.int64)
        first: list[int] = []
        for i, (h, at, n) in enumerate(zip(cols[0].tolist(), cols[1].tolist(), cols[2].tolist(), strict=True)):
            if i and cols[0, i] != cols[0, i - 1]:
                window.clear()  # only windows of one hash are compared
            key = (h, self.text[at : at + n])
            if key not in window:
                window[key] = len(first)
                first.append(i)
            of[i] = window[key]
        pairs = np.unique(np.stack([of, cols[3].astype(np.int64)]), axis=1)
        bits = np.zeros(1 << 21, np.uint8)
        np.bitwise_or.at(bits, (cols[0] >> np.uint64(43)).astype(np.int64), (1 << ((cols[0] >> np.uint64(40)) & np.uint64(7))).astype(np.uint8))
        return {
            "keys": cols[0, first], "at": cols[1, first].astype(np.int64), "n": cols[2, first].astype(np.int64), "bits": bits,
            "edge": np.searchsorted(pairs[0], np.arange(len(first) + 1)), "items": pairs[1],
        }

    def scan(self, norm: bytes) -> tuple[int, np.ndarray, list[str]]:
        """Words of the text, which of them are hit, and the items with windows in it, in order."""
        starts, ends = bounds(norm)
        hit, items = np.zeros(len(starts) + 1, np.int64), set()
        for k, part in self.parts.items():
            if len(starts) < k:
                continue
            h = hashes(norm, starts[: len(starts) - k + 1], ends[k - 1 :])
            maybe_in = (part["bits"][(h >> np.uint64(43)).astype(np.int64)] >> ((h >> np.uint64(40)) & np.uint64(7)).astype(np.uint8)) & 1
            for i in np.flatnonzero(maybe_in).tolist():
                text = norm[starts[i] : ends[i + k - 1]]
                w = int(np.searchsorted(part["keys"], h[i]))
                while w < len(part["keys"]) and part["keys"][w] == h[i]:
                    if part["n"][w] == len(text) and self.text[part["at"][w] : part["at"][w] + len(text)] == text:
                        hit[i] += 1
                        hit[i + k] -= 1
                        items.update(part["items"][part["edge"][w] : part["edge"][w + 1]].tolist())
                        break
                    w += 1
        return len(starts), np.cumsum(hit[:-1]) > 0, [self.names[i] for i in sorted(items)]


def runs(hit: np.ndarray) -> list[dict[str, int]]:
    """Longest stretches of hit words, by the numbers of their first and last word."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": a, "last": z - 1} for a, z in edge.reshape(-1, 2).tolist()]


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def is_small(items: DataFrame, most_bytes: int, most_words: int) -> bool:
    """Whether the benchmark may be broadcast; its words are counted only if its bytes are few."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > most_bytes:
        return False
    return items.agg(F.coalesce(F.sum(F.expr(r"regexp_count(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")), F.lit(0))).first()[0] <= most_words


def scan_with_broadcast(docs: DataFrame, items: DataFrame, size: int, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of the documents with those of ``SCANNED``: one pass over the texts, no shuffle."""
    spark = docs.sparkSession
    shared = broadcast(spark, Index([(r["item"], r["text"].encode()) for r in items.toLocalIterator()], size))
    schema = arrow_schema(SCANNED)
    text_at, carried_at = docs.columns.index("text"), [docs.columns.index(c) for c in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(text_at)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = {f.name: [] for f in schema}
                for text in binary(texts.slice(at, 512)):
                    n, hit, found = index.scan(normal(text))
                    for name, value in zip(out, (n, int(hit.sum()), runs(hit) if found else [], found), strict=True):
                        out[name].append(value)
                new = [pa.array(out[f.name], type=f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in carried_at), *new], names=[*carried, *schema.names])
        relax()

    return docs.mapInArrow(run, StructType([*docs.select(*carried).schema.fields, *StructType.fromDDL(SCANNED).fields]))


def scan_with_join(docs: DataFrame, items: DataFrame, size: int, carried: list[str]) -> DataFrame:
    """The same by a shuffle of the windows that a bitmap of fixed size lets pass; results are made once a distinct text."""
    spark = docs.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                norm = normal(text)
                for k, s, e, h in windows(norm, size):
                    for at in range(0, len(s), 4096):
                        part = slice(at, at + 4096)
                        cut = [norm[a:z] for a, z in zip(s[part].tolist(), e[part].tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict({"item": pa.array([name] * len(cut)), "k": pa.array([k] * len(cut), pa.int32()), "key": pa.array(h[part].view(np.int64)), "window": pa.array(cut, pa.binary())})

    of = materialize(items.mapInArrow(of_items, "item string, k int, key long, window binary").distinct(), "leak-windows")
    lengths = [r["k"] for r in of.select("k").distinct().collect()]  # at most ``size`` values
    shared = broadcast(spark, bitmap(of.select("key")))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for text in binary(batch.column(0)):
                norm = normal(text)
                starts, ends = bounds(norm)
                for k in lengths:
                    if len(starts) < k:
                        continue
                    h = hashes(norm, starts[: len(starts) - k + 1], ends[k - 1 :])
                    for at in range(0, len(h), 4096):
                        place = np.flatnonzero(maybe(bits, h[at : at + 4096])) + at
                        if len(place):
                            cut = [norm[a:z] for a, z in zip(starts[place].tolist(), ends[place + k - 1].tolist(), strict=True)]
                            yield pa.RecordBatch.from_pydict({"text_key": pa.array([md5(norm).digest()] * len(cut), pa.binary()), "k": pa.array([k] * len(cut), pa.int32()), "key": pa.array(h[place].view(np.int64)), "window": pa.array(cut, pa.binary()), "at": pa.array(place, pa.int64())})

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [normal(t) for t in binary(batch.column(batch.schema.get_field_index("text")))]
            new = [pa.array([md5(x).digest() for x in norm], pa.binary()), pa.array([x.count(b" ") + 1 if x else 0 for x in norm], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in carried_at), *new], names=[*carried, "text_key", "n_words"])

    texts = docs.select("text").where("text is not null")
    seen = materialize(texts.mapInArrow(of_docs, "text_key binary, k int, key long, window binary, at long").distinct(), "leak-seen")
    hits = materialize(seen.join(of.select("key", "window").distinct(), ["key", "window"], "left_semi"), "leak-hits")
    items_in = hits.select("text_key", "key", "window").distinct().join(of.select("key", "window", "item"), ["key", "window"]).groupBy("text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    by_text = Window.partitionBy("text_key").orderBy("at", "k")
    before = by_text.rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("text_key", "at", "k", (F.coalesce(F.max(F.col("at") + F.col("k")).over(before), F.lit(0)) < F.col("at")).cast("int").alias("opens")).withColumn("run", F.sum("opens").over(by_text))
    merged = spans.groupBy("text_key", "run").agg(F.min("at").cast("int").alias("first"), (F.max(F.col("at") + F.col("k")) - 1).cast("int").alias("last"))
    of_text = merged.groupBy("text_key").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("hits")).join(items_in, "text_key")
    carried_at = [docs.columns.index(c) for c in carried]
    keyed = docs.mapInArrow(words_of, StructType([*docs.select(*carried).schema.fields, *StructType.fromDDL("text_key binary, n_words long").fields]))
    out = keyed.join(of_text, "text_key", "left")
    filled = {"n_hit": F.coalesce("n_hit", F.lit(0)), "hits": F.coalesce("hits", F.expr("cast(array() as array<struct<first:int,last:int>>)")), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))}
    return out.withColumns({c: x.cast("long") if c == "n_hit" else x for c, x in filled.items()}).select(*carried, "n_words", "n_hit", "hits", "items")


def _scan(docs: DataFrame, benchmark: DataFrame, carried: list[str], size: int, most_bytes: int, most_words: int) -> DataFrame:
    items = items_of(benchmark)
    return (scan_with_broadcast if is_small(items, most_bytes, most_words) else scan_with_join)(docs, items, size, carried)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_bytes: int = MOST_BYTES, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, hits (runs of hit words, from 0), items (ids, sorted as strings) of every document.

    Null and empty texts have no words and no hits. An item without words is in
    no document, a null item id counts as an empty one, repeated items count
    once. Every row of ``docs`` gives one row, repeated or without id. An empty
    table gives no rows, an empty benchmark no hits. Other columns are not read.
    """
    return _scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, ["doc_id"], size, most_bytes, most_words)


def digest(leaks: DataFrame) -> DataFrame:
    """The counts of ``find_leaks`` with a digest of the items in place of their list."""
    listed: Column = F.array_join("items", ",")
    return leaks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, **bounds_: int) -> DataFrame:
    """The documents without those that hold a window, with their own columns."""
    return _held(docs, benchmark, size, **bounds_).where(F.size(f"{_NEW}.hits") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, **bounds_: int) -> DataFrame:
    """The documents with their own columns, and texts from which each run of hit words is cut, first letter to last.

    What stands between and around the words stays; a text without hits, or
    null, stays as it is. ``n_chars`` is not changed.
    """
    held = _held(docs, benchmark, size, **bounds_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(batch.schema.get_field_index("text")))
            hits = batch.column(batch.num_columns - 1).field("hits").to_pylist()
            out = [cut(t, h) if h else t for t, h in zip(texts, hits, strict=True)]
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != _NEW}
            columns["text"] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return held.mapInArrow(run, docs.schema)


_NEW = "kgspark_leaks"


def _held(docs: DataFrame, benchmark: DataFrame, size: int, most_bytes: int = MOST_BYTES, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents with what was found as one last column, so that no name clashes."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*own).withColumnRenamed(own[at], "text")
    out = _scan(plain, benchmark, plain.columns, size, most_bytes, most_words)
    return out.select(*(F.col("text" if i == at else c).alias(docs.columns[i]) for i, c in enumerate(own)), F.struct("n_words", "n_hit", "hits", "items").alias(_NEW))


def cut(text: bytes, hits: list[dict[str, int]]) -> bytes:
    """``text`` without the runs of words that ``hits`` numbers."""
    flat = np.frombuffer(text.translate(WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for h in hits:
        out.append(text[at : starts[h["first"]]])
        at = int(ends[h["last"]])
    return b"".join([*out, text[at:]])


#: Windows by lists of words; the same rows.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
lengths AS (SELECT DISTINCT k FROM win),
seen AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN lengths ON len(w) >= k)),
hits AS (SELECT DISTINCT seen.r, seen.k, seen.i, win.item FROM seen JOIN win ON seen.k = win.k AND seen.win = win.win),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.r = d.r LEFT JOIN found f ON f.r = d.r
"""
