"""LM scoring with a probabilistic suffix tree over words.

Symbols are words (ASCII lower-cased, split at ASCII white space) and one end
mark for each text. Counts come from all training texts. Every context of up to
``depth`` words that occurs at least ``least`` times is tested, whatever the size
of the corpus: it keeps next symbols of conditional probability ``gamma_min`` or
more whose ratio to the suffix's estimate passes ``ratio``, and is retained if
its log-likelihood gain over its suffix exceeds a description length of ``cost``
* ln(N) / 2 for each kept symbol. Kept symbols are discounted by ``discount``;
the mass left goes to the suffix's estimate of the others (Katz), down to
add-one unigrams over every word of the corpus.

The tree and the unigrams are distributed tables keyed by 64-bit hashes. A score
is a sum of table values: log10 of the unigram, of the back-off factor of every
retained context, and for a kept symbol its gain over what it would have backed
off to. So the most frequent keys are added in the workers, and all others meet
their table rows in buckets of the hashes, to which both sides are dealt. A bitmap
of fixed size tells which contexts may be in the tree; it only saves lookups that
would find nothing.

Counts, lookups and their answers travel as packed arrays (``pack``), sorted within
a bucket, not as rows: hashes dominate them, and the rows' overhead would double
their size. Counts are dealt by their context, so a bucket holds all that follows a
context and knows its size; contexts too frequent for one bucket are dealt by the
whole sequence, their sizes are known from the level below. Buckets are as many as
the tokens ask for, so that a worker holds one at a time. The sums of a block of
documents come back from each bucket in one packed row and are added by block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.runtime import discard, materialize

from . import common
from .packs import narrow, pack, unpack

END = b""
#: Bytes of texts encoded at once in a worker, if not of one text, and of words hashed at once; bound memory, not input.
BYTES = 1 << 20
PIECE = 1 << 18
#: Rows of a table packed at once in a worker.
TABLE_ROWS = 400_000
#: Longer words are hashed one by one.
LONG = 64


#: Base of the rolling hash, its inverse, and the hash of a text's beginning.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
START = np.uint64(0x6A09E667F3BCC909)
#: Hash of the end mark.
END_HASH = np.uint64(xxhash.xxh64_intdigest(END, 42))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: A number for each byte of a word, the same for A-Z and a-z, 0 for white space; weights by place, and their inverses.
_BYTES = np.where(_SPACE, 0, np.array([xxhash.xxh64_intdigest(bytes([b]).lower(), 7) for b in range(256)], dtype=np.uint64)).astype(np.uint64)
_SHARE = 0xD6E8FEB86659FD93
_WEIGHTS = _powers(_SHARE, PIECE + LONG)
_UNWEIGHTS = _powers(pow(_SHARE, -1, 1 << 64), PIECE + LONG)


@dataclass(frozen=True)
class Settings:
    #: Words of the longest context, and occurrences that a context and a kept symbol need.
    depth: int = 3
    least: int = 2
    #: Share of all tokens that a context needs besides; none by default.
    p_min: float = 0.0
    gamma_min: float = 0.05
    ratio: float = 1.5
    cost: float = 1.0
    discount: float = 0.5
    #: Keys of this share of all tokens are added in the workers, not by the join; where, not what, is added.
    hot: float = 2e-6
    #: A tenth of the words and sequences gathered in a worker before they are counted and sent on; bounds memory, not input.
    flush: int = 80_000
    #: Training tokens for which there is one bucket.
    bucket: int = 1_500_000

    def buckets(self, tokens: int) -> int:
        """A power of two: a bucket is a range of the upper bits of a hash."""
        return 1 << max(0, -(-tokens // self.bucket) - 1).bit_length()

    def wide(self) -> int:
        """Occurrences from which a context is too frequent for one bucket; at most 4 contexts a bucket are."""
        return max(2, self.bucket // 4)


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z, splits at bytes 20 and 09-0D, adds the end mark."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of texts that follow one another in ``data`` and begin at ``begins``; none crosses two texts."""
    word = ~_SPACE[data]
    first = np.ones(len(data) + 1, dtype=bool)
    np.logical_not(word[:-1], out=first[1:-1])
    first[begins] = True  # the last ones may be empty and begin where the data ends
    at = np.flatnonzero(word & first[:-1])
    out = np.empty(len(at), dtype=np.uint64)
    after = np.append(at[1:], len(data))
    edges = np.searchsorted(at, np.arange(0, len(data) + PIECE, PIECE)).tolist()
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            base, end = at[lo], min(at[hi - 1] + LONG, after[hi - 1])
            place = at[lo:hi] - base
            out[lo:hi] = np.add.reduceat(_BYTES[data[base:end]] * _WEIGHTS[: end - base], place) * _UNWEIGHTS[place]
    out = _mixed(out)
    for i in np.flatnonzero(after - at > LONG).tolist():
        w = data[at[i] : after[i]].tobytes().rstrip()
        if len(w) > LONG:
            out[i] = xxhash.xxh64_intdigest(w.lower(), 42)
    return at, out


def encoded(texts: pa.Array):  # noqa: ANN201
    """Parts of a column: range of rows, hashes of all tokens with a start mark before each text, where texts begin in them."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, ends, values = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BYTES, "right")) - 1)
        hi = min(hi, lo + BYTES // 64)
        begins = ends[lo:hi] - ends[lo]
        data = np.frombuffer(values, dtype=np.uint8, count=int(ends[hi] - ends[lo]), offset=int(ends[lo])) if ends[hi] > ends[lo] else np.zeros(0, np.uint8)
        at, found = hashes(data, begins)
        each = np.diff(np.append(np.searchsorted(at, begins), len(at)))
        starts = np.concatenate([[0], np.cumsum(each + 2)]).astype(np.int64)
        flat = np.empty(starts[-1], dtype=np.uint64)
        flat[np.arange(len(at)) + 2 * np.repeat(np.arange(hi - lo), each) + 1] = found
        flat[starts[:-1]], flat[starts[1:] - 1] = START, END_HASH
        yield lo, hi, flat, starts
        lo = hi


def runs(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(sorted_[0]):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], 1 + np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_]))])


def lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    order = np.argsort(x)
    first = runs(x[order])
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(first)), lengths(first, len(x)))
    return x[order[first]], place


def grams(flat: np.ndarray, starts: np.ndarray, depth: int, least: int = 1):  # noqa: ANN201
    """For each context length ``least``..``depth``: positions of the next symbols, hashes of context, of both, and of both without the oldest word."""
    valid = np.ones(len(flat), dtype=bool)
    valid[starts[:-1]] = False  # a start mark is no symbol, and only the oldest word of a context
    shorter, power = flat, BASE
    for k in range(1, depth + 1):
        if k > 1:
            valid = valid & np.concatenate([[False], valid[:-1]])
        whole = flat.copy()
        whole[k:] = flat[:-k] * power + shorter[k:]
        if k >= least:
            at = np.flatnonzero(valid)
            at = at[at >= k]
            yield at, shorter[at - 1], whole[at], shorter[at]
        shorter, power = whole, _power(k + 1)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(BASE), k, 1 << 64))


def _slices(order_key: np.ndarray, buckets: int):  # noqa: ANN202
    """(bucket, slice) of the non-empty buckets of sorted hashes."""
    edges = np.searchsorted(order_key >> np.uint64(64 - buckets.bit_length() + 1) if buckets > 1 else np.zeros(len(order_key), np.uint64), np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(int(edges[k]), int(edges[k + 1]))


def unigrams(train: DataFrame, s: Settings) -> DataFrame:
    """(key, n): hashes of the words of the training texts and of the end mark; counted in each task before they leave it."""
    arrow = common.arrow_schema("key long, n long")

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = runs(key)
        return key[first], np.add.reduceat(n, first)

    def run(batches):  # noqa: ANN001, ANN202
        held, parts, size = None, [], 0
        for batch in batches:
            for _, _, flat, starts in encoded(batch.column(0)):
                word = np.ones(len(flat), dtype=bool)
                word[starts[:-1]] = False
                parts.append((flat[word], np.ones(int(word.sum()), dtype=np.int64)))
                size += len(parts[-1][0])
                if size >= 10 * s.flush:
                    counted = merged(parts)
                    held, parts, size = merged([held, counted]) if held else counted, [], 0
                    if len(held[0]) >= 10 * s.flush:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], schema=arrow)
                        held = None
        if size:
            held = merged([*([held] if held else []), *parts])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], schema=arrow)
        common.relax()

    return train.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Frequent:
    """Bitmap of what occurs often enough one word shorter; the contexts too frequent for one bucket, sorted, and their sizes."""

    bits: np.ndarray
    wide: np.ndarray
    sizes: np.ndarray


def contexts(train: DataFrame, length: int, frequent, buckets: int, least: float, s: Settings) -> DataFrame:  # noqa: ANN001
    """``g, ctx, pg, n, size``: counts of ``length`` words and the next, at least ``s.least``, and of the context, at least ``least``.

    ``frequent`` is the broadcast of what occurs that often one word shorter; a
    sequence can only do so if both its shorter parts do. Of the others only
    their number counts, as part of the context's size. A sequence travels as
    its context's hash with its oldest and newest word, from which the hashes of
    it and of its parts follow. At ``s.depth`` only sequences of ``s.gamma_min``
    or more are given, as no level rests on the others.
    """
    schema = "g long, ctx long, pg long, n long, size long"
    arrow, packed = common.arrow_schema(schema), common.arrow_schema("bucket int, blob binary")
    power, shift = _power(length), np.uint64(65 - buckets.bit_length())

    def blobs(parts: list) -> pa.RecordBatch:
        g, ctx, old, new, ok = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(g)
        first = runs(g[order])
        n, pick = lengths(first, len(g)), order[first]
        g, ctx, old, new, ok = g[pick], ctx[pick], old[pick], new[pick], ok[pick]
        wide = find(frequent.value.wide, ctx)[1]
        to = np.where(wide, g, ctx)
        some = np.flatnonzero(ok | ~wide)
        some = some[np.argsort(to[some])]
        to, ctx, old, new, ok, n = to[some], ctx[some], old[some], new[some], ok[some], n[some]
        at = (to >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(to), np.int64)
        first = runs(ctx, at)
        rest, m = np.add.reduceat(np.where(ok, 0, n), first), np.add.reduceat(ok.astype(np.int64), first)
        ctx, old, at, new, n = ctx[first], old[first], at[first], new[ok], n[ok]
        ends = np.concatenate([[0], np.cumsum(m)])
        rows, edge = [], [*runs(at).tolist(), len(at)]
        for lo, hi in zip(edge, edge[1:]):
            part = slice(ends[lo], ends[hi])
            words, place = distinct(np.concatenate([new[part], old[lo:hi]]) if length > 1 else new[part])
            cut = ends[hi] - ends[lo]
            rows.append((int(at[lo]), pack(ctx[lo:hi], narrow(m[lo:hi]), narrow(rest[lo:hi]), words, narrow(place[:cut]), narrow(place[cut:]), narrow(n[part]))))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), packed, strict=True)], schema=packed)

    def send(batches):  # noqa: ANN001, ANN202
        bits, parts, size = frequent.value.bits, [], 0
        for batch in batches:
            for _, _, flat, starts in encoded(batch.column(0)):
                for place, ctx, g, pg in grams(flat, starts, length, length):
                    some = common.maybe(bits, ctx)
                    if some.any():
                        place = place[some]
                        parts.append((g[some], ctx[some], flat[place - length], flat[place], common.maybe(bits, pg[some])))
                        size += len(place)
                if size >= 10 * s.flush:
                    yield blobs(parts)
                    parts, size = [], 0
        if size:
            yield blobs(parts)
        common.relax()

    def count(batches):  # noqa: ANN001, ANN202
        for group in common.groups(batches, ["bucket"]):
            cols: list[list] = [[] for _ in range(6)]
            before = 0
            for blob in group["blob"]:
                ctx, m, rest, words, new, old, n = unpack(blob)
                m, n = m.astype(np.int64), n.astype(np.int64)
                each = np.repeat(np.arange(len(ctx)), m)
                total = rest.astype(np.int64) + np.bincount(each, n, len(ctx)).astype(np.int64)
                for held, x in zip(cols, (ctx, words[old] if length > 1 else ctx, total, before + each, words[new], n), strict=True):
                    held.append(x)
                before += len(ctx)
            ctx, old, total, each, new, n = (np.concatenate(x) for x in cols)
            cols.clear()
            ctxs, place = distinct(ctx)
            size = np.bincount(place, total, len(ctxs)).astype(np.int64)
            at, wide = find(frequent.value.wide, ctxs)
            size[wide] = frequent.value.sizes[at[wide]]
            g = ctx[each] * BASE + new
            order = np.argsort(g)
            first = runs(g[order])
            some = np.zeros(0, np.int64)
            if len(first):
                n, pick = np.add.reduceat(n[order], first), order[first]
                g, each = g[pick], each[pick]
                ctx, old, size = ctx[each], old[each], size[place[each]]
                need = s.gamma_min * size if length == s.depth else 0
                some = np.flatnonzero((n >= s.least) & (n >= need) & ((size >= least) | (ctx == START)))
            if len(some):
                g, ctx, old, n, size = g[some], ctx[some], old[some], n[some], size[some]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), ctx.view(np.int64), (g - old * power).view(np.int64), n, size)], schema=arrow)
        common.relax()

    return train.mapInArrow(send, "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, schema)


def grow(train: DataFrame, table: DataFrame, totals: tuple[int, int, int], s: Settings) -> list[DataFrame]:
    """The tree as tables of ``ctx, g, value, n``: what log10 of a probability gains by a retained context (null ``g``) and by a symbol kept in it.

    ``n`` counts the context. A level's estimates rest on those of the level
    below, by one join on the sequence without its oldest word.
    """
    tokens, types, texts = totals
    spark, least = train.sparkSession, max(s.least, s.p_min * tokens)
    shorter = table.where(F.col("n") >= max(1.0, s.p_min * tokens)).select(F.col("key").alias("g"), "n", ((F.col("n") + 1) / (tokens + types + 1)).alias("q"))
    begin = spark.createDataFrame([(int(START.view(np.int64)), texts)], "g long, n long")
    out: list[DataFrame] = []
    level = None
    for k in range(1, s.depth + 1):
        below = shorter.select("g", "n").unionByName(begin) if k == 1 else shorter.select("g", "n")
        wide = _sorted(below.where(F.col("n") >= s.wide()).toArrow())
        frequent = common.broadcast(spark, Frequent(common.bitmap(below.where(F.col("n") >= s.least).select(F.col("g").alias("key"))), wide[0], wide[1].astype(np.int64)))
        found = materialize(contexts(train, k, frequent, s.buckets(tokens), least, s), f"pst-found-{k}")
        n, size, q = F.col("n"), F.col("size"), F.col("q")
        good = (n >= s.gamma_min * size) & ((n / size >= s.ratio * q) | (n / size * s.ratio <= q))
        frequent.destroy()
        tried = materialize(found.join(shorter.select(F.col("g").alias("pg"), "q"), "pg").select("g", "ctx", "n", "size", "q", good.alias("good")), f"pst-tried-{k}")
        discard(found, level)
        sums = tried.where("good").groupBy("ctx", "size").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("kept"), F.sum("q").alias("q_sum"), F.sum(n * F.log(n / size / q)).alias("gain")).where("q_sum < 1")
        p = F.col("kept") / size
        gain = F.col("gain") + F.when(F.col("kept") < size, size * (1 - p) * F.log((1 - p) / (1 - F.col("q_sum")))).otherwise(0.0)
        back = (1 - (F.col("kept") - s.discount * F.col("m")) / size) / (1 - F.col("q_sum"))
        nodes = materialize(sums.where(gain >= s.cost * F.col("m") * float(np.log(max(tokens, 2))) / 2).select("ctx", "size", F.greatest(back, F.lit(1e-300)).alias("back")), f"pst-nodes-{k}")
        p = (n - s.discount) / size
        value = (F.log10(p) - F.log10("q") - F.log10("back")).alias("value")
        if k < s.depth:
            own = tried.join(nodes.select("ctx", "back"), "ctx", "left")
            kept = F.col("good") & F.col("back").isNotNull()
            level = own.select("g", "n", F.when(kept, p).when(F.col("back").isNotNull(), F.col("back") * q).otherwise(q).alias("p"), F.when(kept, F.col("ctx")).alias("ctx"), F.when(kept, value).alias("value"), F.when(kept, size).alias("size"))
            level = materialize(level, f"pst-level-{k}")
            kept = level.where("ctx is not null").select("ctx", "g", "value", F.col("size").alias("n"))
            shorter = level.select("g", "n", F.col("p").alias("q"))
        else:
            kept = tried.where("good").join(nodes.select("ctx", "back"), "ctx").select("ctx", "g", value, size.alias("n"))
        rows = nodes.select("ctx", F.lit(None).cast("long").alias("g"), F.log10("back").alias("value"), F.col("size").alias("n"))
        out.append(rows.unionByName(materialize(kept, f"pst-kept-{k}")))
        discard(tried)
    return out


@dataclass
class Hot:
    """Sorted keys and values of the most frequent words, of the most frequent retained contexts and of all symbols kept in these; and the bitmap of all retained contexts."""

    words: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    backs: np.ndarray
    kept: np.ndarray
    gains: np.ndarray
    bits: np.ndarray


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, values = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy().astype(np.float64)
    order = np.argsort(keys)
    return keys[order], values[order]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _symbol(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of a symbol kept in a context, from the lower half of the word's hash."""
    return ctx * BASE ^ (word & np.uint64(0xFFFFFFFF)) * INVERSE


#: What a packed row holds: rows of the tree, rows of the unigrams, lookups in either, and documents' own sums.
TREE, WORDS, IN_TREE, IN_WORDS, OWN = range(5)
_PACKED = "bucket int, kind int, block long, blob binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
_ANSWERS = "block long, kind int, blob binary"
_ANSWERS_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_SUMS = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"
_SUMS_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])


def _packed_batch(rows: list[tuple], arrow: pa.Schema = _PACKED_ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _packed_table(table: DataFrame, kind: int, buckets: int) -> DataFrame:
    """A table's rows (key, other longs or doubles) as packed arrays by the bucket of the key."""

    def rows(parts: list) -> list[tuple]:
        key, *cols = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key)
        key, cols = key[order], [c[order] for c in cols]
        return [(k, kind, None, pack(key[part], *(c[part] for c in cols))) for k, part in _slices(key, buckets)]

    def run(batches):  # noqa: ANN001, ANN202
        parts, size = [], 0
        for b in batches:
            key, *cols = [c.fill_null(0).to_numpy() for c in b.columns]
            parts.append((key.astype(np.int64).view(np.uint64), *cols))
            size += len(key)
            if size >= TABLE_ROWS:
                yield _packed_batch(rows(parts))
                parts, size = [], 0
        if size:
            yield _packed_batch(rows(parts))

    return table.mapInArrow(run, _PACKED)


def _meet(batches):  # noqa: ANN001, ANN202
    """Sorted by bucket and kind: hold a bucket's table rows, let its lookups pass, sum by document of their block."""
    none = np.zeros(0, np.uint64), np.zeros(0)
    bucket, tables, ready = None, {}, {}

    def table(kind: int) -> tuple[np.ndarray, ...]:
        """Sorted keys and values: of retained contexts and of kept symbols, or of words."""
        if kind not in tables:
            return none * 2 if kind == TREE else none
        if kind not in ready:
            parts = [np.concatenate(x) for x in zip(*tables[kind], strict=True)]
            if kind == TREE:
                ctx, g, value, is_back = parts
                is_back = is_back.astype(bool)
                names = np.where(is_back, ctx, _symbol(ctx, g.view(np.uint64) - ctx * BASE))
                sides = [(names[m], value[m]) for m in (is_back, ~is_back)]
                ready[kind] = tuple(x for key, v in sides for x in (np.sort(key), v[np.argsort(key)]))
            else:
                order = np.argsort(parts[0])
                ready[kind] = parts[0][order], parts[1][order]
        return ready[kind]

    for batch in batches:
        out = []
        for b, kind, block, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                bucket, tables, ready = b, {}, {}
            if kind in (TREE, WORDS):
                tables.setdefault(kind, []).append(unpack(blob))
            elif kind == OWN:
                out.append((block, kind, blob))
            else:
                key, n, doc, *word = unpack(blob)
                docs, place = np.unique(doc, return_inverse=True)
                if kind == IN_TREE:
                    backs, factor, kept, gain = table(TREE)
                    value = np.repeat(_values(backs, factor, key), n) + _values(kept, gain, _symbol(np.repeat(key, n), word[0].astype(np.uint64)))
                    sums = (np.bincount(place, value, len(docs)),)
                else:
                    keys, logs = table(WORDS)
                    at, there = find(keys, key)
                    value = np.where(there, logs[at], 0.0) if len(keys) else np.zeros(len(key))
                    sums = narrow(np.bincount(place, np.repeat(there, n), len(docs)).astype(np.int64)), np.bincount(place, np.repeat(value, n), len(docs))
                out.append((block, kind, pack(docs, *sums)))
        if out:
            yield _packed_batch(out, _ANSWERS_ARROW)
    common.relax()


def _add(batches):  # noqa: ANN001, ANN202
    """Sorted by block: a block's documents with the sums of all buckets."""
    for group in common.groups(batches, ["block"]):
        own, answers = None, []
        for kind, blob in zip(group["kind"], group["blob"], strict=True):
            if kind == OWN:
                own = unpack(blob)
            else:
                answers.append((kind, unpack(blob)))
        doc_id, null, held, n, *sums = own
        known, base, model = (x.copy() for x in sums)
        for kind, (doc, *sums) in answers:  # a document is there once in each
            if kind == IN_TREE:
                model[doc] += sums[0]
            else:
                known[doc] += sums[0].astype(np.int64)
                base[doc] += sums[1]
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=null.astype(bool)), pa.array(held.astype(bool)), *map(pa.array, (n, known, base, model))], schema=_SUMS_ARROW)


def _values(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, 0 where there is none."""
    at, there = find(keys, wanted)
    return np.where(there, values[at], 0.0) if len(keys) else np.zeros(len(wanted))


class _Block:
    """Documents gathered in a worker with the lookups of their words and contexts."""

    def __init__(self, h: Hot, name: int, buckets: int) -> None:
        self.h, self.name, self.buckets, self.size, self.n = h, name, buckets, 0, 0
        self.docs: list = []
        self.held: dict[int, list] = {IN_TREE: [], IN_WORDS: []}

    def add(self, kind: int, doc: np.ndarray, *key: np.ndarray) -> None:
        self.held[kind].append((doc, *key))
        self.size += len(doc)

    def rows(self) -> list[tuple]:
        """Sums over what is hot, and what is not as packed arrays by bucket."""
        known, base, model = np.zeros(self.n, np.int64), np.zeros(self.n), np.zeros(self.n)
        h, out = self.h, []
        for kind, parts in self.held.items():
            if not parts:
                continue
            doc, key, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.argsort(key)
            doc, key, more = doc[order], key[order], [x[order] for x in more]
            first = runs(key)
            key, n = key[first], lengths(first, len(doc))
            at, there = find(h.words if kind == IN_WORDS else h.contexts, key)
            hot = np.repeat(there, n)
            value = np.repeat((h.logs if kind == IN_WORDS else h.backs)[at[there]], n[there])
            if kind == IN_WORDS:
                known += np.bincount(doc[hot], minlength=self.n)
                base += np.bincount(doc[hot], value, self.n)
            else:
                name = _symbol(np.repeat(key[there], n[there]), more[0][hot].astype(np.uint64))
                model += np.bincount(doc[hot], value + _values(h.kept, h.gains, name), self.n)
            doc, more, key, n = doc[~hot], [x[~hot] for x in more], key[~there], n[~there]
            ends = np.concatenate([[0], np.cumsum(n)])
            for k, part in _slices(key, self.buckets):
                own = slice(ends[part.start], ends[part.stop])
                out.append((k, kind, self.name, pack(key[part], narrow(n[part]), narrow(doc[own]), *(x[own] for x in more))))
        doc_id, null, held, n = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        out.append((self.name % self.buckets, OWN, self.name, pack(doc_id, null, held, n, known, base, model)))
        return out


def score_documents(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text by a tree learnt from those with crc32(id as text) mod 7 not 2.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``, one row for each row in, repeated rows included. Null text is the
    empty text (its end mark only); a null id counts as the empty text in the
    fold. Without training texts every token has probability 1 / (0 + 0 + 1). Very
    long texts are read whole, an empty table gives no rows, and other columns are
    not read, so their names cannot clash.
    ``docs`` is read once a level and once for the scores, and rows are told apart
    by their place in it: pass a stored table, not a plan that shuffles.
    """
    s = settings
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(f"{common.crc_text(id_col)} % 7 = 2").alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    table = materialize(unigrams(train, s), "pst-unigrams")
    total = table.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("key") == int(END_HASH.view(np.int64)), F.col("n")))).first()
    tokens, types, texts = totals = tuple(int(x or 0) for x in total)
    tree = reduce(DataFrame.unionByName, grow(train, table, totals, s))
    buckets = s.buckets(tokens)
    often = F.col("n") >= max(1.0, s.hot * tokens)  # at most 1/hot words and contexts of a length, and 1/gamma_min symbols in each
    logs = table.select("key", F.log10(F.col("n") + 1).alias("value"), "n")
    backs = tree.where("g is null").select("ctx", "value", "n")
    kept = tree.where("g is not null").select("ctx", "g", "value", "n")
    ctx, g, value = (c.to_numpy() for c in kept.where(often).drop("n").toArrow().columns)
    ctx, g = ctx.astype(np.int64).view(np.uint64), g.astype(np.int64).view(np.uint64)
    name = _symbol(ctx, g - ctx * BASE)
    order = np.argsort(name)
    hot = Hot(*(x for side in (logs, backs) for x in _sorted(side.where(often).drop("n").toArrow())), name[order], value.astype(np.float64)[order], common.bitmap(tree.where("g is null").select(F.col("ctx").alias("key"))))
    shared = common.broadcast(spark, hot)

    def run(batches):  # noqa: ANN001, ANN202
        h, name = shared.value, TaskContext.get().partitionId() << 33
        block = _Block(h, name, buckets)
        for batch in batches:
            doc_id, held = batch.column(0), batch.column(1)
            for lo, hi, flat, starts in encoded(batch.column(2)):
                own, texts = doc_id.slice(lo, hi - lo), np.diff(starts)
                block.docs.append((own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False).view(np.uint8), held.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.uint8), texts - 1))
                doc = np.repeat(np.arange(block.n, block.n + hi - lo, dtype=np.uint32), texts)
                block.n += hi - lo
                word = np.ones(len(flat), dtype=bool)
                word[starts[:-1]] = False
                block.add(IN_WORDS, doc[word], flat[word])
                for place, ctx, _, _ in grams(flat, starts, s.depth):
                    hit = common.maybe(h.bits, ctx)
                    place = place[hit]
                    block.add(IN_TREE, doc[place], ctx[hit], flat[place].astype(np.uint32))
                if block.size >= 20 * s.flush:
                    yield _packed_batch(block.rows())
                    name += 1
                    block = _Block(h, name, buckets)
        if block.n:
            yield _packed_batch(block.rows())
        common.relax()

    sides = [
        _packed_table(tree.where(~often).select("ctx", "g", "value", F.col("g").isNull().cast("tinyint")), TREE, buckets),
        _packed_table(logs.where(~often).select("key", "value"), WORDS, buckets),
        rows.select("doc_id", "held_out", "text").mapInArrow(run, _PACKED),
    ]
    met = reduce(DataFrame.unionByName, sides).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_meet, _ANSWERS)
    sums = met.repartition("block").sortWithinPartitions("block").mapInArrow(_add, _SUMS)
    base = F.col("base") - F.col("n_tokens") * float(np.log10(tokens + types + 1))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("model")).alias("score"))
