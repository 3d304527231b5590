"""Pairs of alike names in blocks: all names of a block meet all of another in arrays, and ids are paired last.

Where names of one pattern are alike in large parts of all pairs (numbered
suppliers), or one name has thousands of ids, rows for every pair on the way
cost more than the comparison. Here a name and up to ``CHUNK`` of its ids are
one entry, entries of one type and length are dealt to blocks, and only what
passes the metric becomes rows:

* letters that two names share, in any order, from bit sets of (letter, how many of it);
* letters that they share in order, by a bit-parallel longest common subsequence;
* the metric itself: edit distance (bit-parallel) or matched blocks, for many pairs at once.

A task holds two blocks, at most; which blocks meet follows from types and lengths.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.runtime import materialize, shuffled, spread

from .simjoin import matched, matched_column

#: Ids of an entry, ids up to which it is light, entries of a block, letters of a name that fits a machine word.
CHUNK, LIGHT, ENTRIES, LONGEST = 1024, 8, 2048, 64
#: Comparisons of bit sets, and pairs that a step of the metric works on, at once; columns of a search for runs.
CELLS, STEP, COLUMNS = 1 << 22, 1 << 18, 1 << 13


def _codes(names: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(names), length)


def _bags(codes: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Bit sets of (letter, how many of it so far), by the places of ``items``."""
    out = np.zeros((len(codes), (len(items) + 63) // 64), np.uint64)
    rows = np.arange(len(codes))
    for p in range(codes.shape[1]):
        at = np.searchsorted(items, _item(codes, p))
        out[rows, at // 64] |= np.uint64(1) << (at % 64).astype(np.uint64)
    return out


def _item(codes: np.ndarray, p: int) -> np.ndarray:
    return codes[:, p].astype(np.int64) * LONGEST + (codes[:, :p] == codes[:, p : p + 1]).sum(axis=1)


def _places(codes: np.ndarray, letters: int) -> np.ndarray:
    """``[name, letter]``: the places of a letter in a name, as bits."""
    out, rows = np.zeros((len(codes), letters), np.uint64), np.arange(len(codes))
    for p in range(codes.shape[1]):
        out[rows, codes[:, p]] |= np.uint64(1 << p)
    return out


def in_order(x: np.ndarray, places: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Letters that rows of ``x`` share in order with the names ``j`` of ``places``."""
    v = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
    for p in range(x.shape[1]):
        u = v & places[j, x[:, p]]
        v = (v + u) | (v - u)
    return length - np.bitwise_count(v & np.uint64((1 << length) - 1)).astype(np.int64)


def edit_distances(x: np.ndarray, places: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Edit distances of rows of ``x`` to the names ``j`` of ``places``."""
    one, top = np.uint64(1), np.uint64(length - 1)
    more, less = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(x), np.uint64)
    out = np.full(len(x), length, np.int64)
    for p in range(x.shape[1]):
        eq = places[j, x[:, p]]
        xv, xh = eq | less, (((eq & more) + more) ^ more) | eq
        ph, mh = less | ~(xh | more), more & xh
        out += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        ph, mh = (ph << one) | one, mh << one
        more, less = mh | ~(xv | ph), ph & xv
    return out


def _longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in ``x`` and ``y`` and size of the longest common run of each column, the first in ``x``, then in ``y``."""
    m, n = len(y), x.shape[1]
    run, best, end = np.zeros((m + 1, n), np.uint16), np.zeros(n, np.uint16), np.zeros(n, np.int64)
    place = (m - np.arange(1, m + 1)).astype(np.uint16)[:, None]  # the earlier in y, the larger
    for p in range(len(x)):
        new = (run[:-1] + np.uint16(256)) * (y == x[p])
        run[1:] = new
        top = (new + place).max(axis=0)
        longer = (top >> 8) > (best >> 8)
        best, end = np.where(longer, top, best), np.where(longer, p + 1, end)
    size = (best >> 8).astype(np.int64)
    return end - size, m - (best & 255).astype(np.int64) - size, size


def matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Letters in the matching blocks of rows of ``x`` and ``y`` as ``difflib`` finds them (names under 200 letters)."""
    out = np.zeros(len(x), np.int64)
    xs, ys = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    zero = np.zeros(len(x), np.int64)
    level = [np.arange(len(x)), zero, zero, zero + len(xs), zero + len(ys)]
    while len(level[0]):
        shape = level[3] * 256 + level[4]
        order = np.argsort(shape, kind="stable")
        level = [v[order] for v in level]
        starts = np.nonzero(np.diff(shape[order], prepend=-1))[0]
        nxt = []
        for at, to in zip(starts, [*starts[1:], len(order)], strict=True):
            wide, high = int(level[3][at]), int(level[4][at])
            for s in range(at, to, COLUMNS):
                rows, a, b = (v[s : min(s + COLUMNS, to)] for v in level[:3])
                i, j, k = _longest(xs[a + np.arange(wide)[:, None], rows], ys[b + np.arange(high)[:, None], rows])
                np.add.at(out, rows, k)  # a name may have two parts of one shape
                nxt += [(rows[k > 0], *(v[k > 0] for v in part)) for part in ((a, b, i, j), (a + i + k, b + j + k, wide - i - k, high - j - k))]
        level = [np.concatenate(v) for v in zip(*nxt, strict=True)]
        open_ = (level[3] > 0) & (level[4] > 0)
        level = [v[open_] for v in level]
    return out


def _alike(a: list[str], b: list[str], x: int, y: int, threshold: float, edits: bool, same: bool, raw: tuple[list[str], list[str]], ratio: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``i, j, similarity, swapped`` of the alike names of two blocks; if both are the ``same``, i <= j."""
    need = matched(x, y, threshold, edits)
    ca, cb = _codes(a, x), _codes(b, y)
    letters, codes = np.unique(np.concatenate([ca.ravel(), cb.ravel()]), return_inverse=True)
    small = codes.astype(np.uint16)
    ca, cb = small[: ca.size].reshape(ca.shape), small[ca.size :].reshape(cb.shape)
    # what all names of both begin with adds to what two share and nothing to their distance
    first = (ca[:, : min(x, y)] == ca[0, : min(x, y)]).all(axis=0) & (cb[:, : min(x, y)] == ca[0, : min(x, y)]).all(axis=0)
    begin = int(np.argmin(first)) if not first.all() else max(0, min(x, y) - 1)
    da, db, rest = ca[:, begin:], cb[:, begin:], y - begin
    seen = [np.unique(_item(c, p)) for c in (da, db) for p in range(c.shape[1])]
    items = np.unique(np.concatenate(seen)) if seen else np.zeros(1, np.int64)
    bag_a, bag_b, places = _bags(da, items), _bags(db, items), _places(db, max(1, len(letters)))
    rank = {name: r for r, name in enumerate(sorted({*raw[0], *raw[1]}))}
    rank_a, rank_b = (np.array([rank[n] for n in names]) for names in raw)
    if not edits:  # the metric's own lower case may differ from the JVM's
        odd_a, odd_b = (np.array([r.lower().strip() != n for r, n in zip(rs, ns, strict=True)]) for rs, ns in zip(raw, (a, b), strict=True))
    slab = max(1, CELLS // len(b))
    for at in range(0, len(a), slab):
        shared = sum(np.bitwise_count(bag_a[at : at + slab, None, w] & bag_b[None, :, w]) for w in range(bag_a.shape[1]))
        near = shared >= need - begin
        if same:
            near &= np.arange(len(b))[None, :] >= np.arange(at, min(at + slab, len(a)))[:, None]
        every_i, every_j = np.nonzero(near)
        for s in range(0, len(every_i), STEP):
            i, j = every_i[s : s + STEP] + at, every_j[s : s + STEP]
            if x and y:
                fit = in_order(da[i], places, j, rest) >= need - begin
                i, j = i[fit], j[fit]
            swapped = rank_a[i] > rank_b[j]
            if not (x and y):
                score = np.full(len(i), 1.0 if x == y else 0.0)
            elif edits:
                score = 1 - edit_distances(da[i], places, j, rest) / max(x, y)
            else:
                score = np.zeros(len(i))
                for turned in (False, True):
                    k = np.nonzero(swapped == turned)[0]
                    one, two = ca[i[k]], cb[j[k]]
                    score[k] = 2.0 * (matches(two, one) if turned else matches(one, two)) / (x + y)
            if not edits:
                for k in np.nonzero(odd_a[i] | odd_b[j])[0]:
                    u, v = raw[0][i[k]], raw[1][j[k]]
                    score[k] = ratio(v, u) if swapped[k] else ratio(u, v)
            good = score >= threshold
            yield i[good], j[good], score[good], swapped[good]


def _flat(batch: pa.RecordBatch, side: str, row: int) -> tuple[list[str], list[str], pa.Array]:
    items = batch.column(side)[row].values
    return items.field("name").to_pylist(), items.field("n").to_pylist(), items.field("ids")


def _compared(threshold: float, edits: bool, ratio: Callable, light: bool) -> Callable:
    """Alike names of two blocks: with their ids, each pair a row, if entries are ``light``, else with the numbers of the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y, same = (batch.column(c)[row].as_py() for c in ("x", "y", "same"))
                sides = [batch.column(c)[row].values for c in ("a", "b")]
                (raw_a, a), (raw_b, b) = ((s.field("name").to_pylist(), s.field("n").to_pylist()) for s in sides)
                names = pa.array(raw_a + raw_b, pa.string())
                ends = pa.concat_arrays([s.field("ids" if light else "e") for s in sides])
                sizes = np.asarray(ends.value_lengths()) if light else np.ones(len(names), np.int64)
                starts, flat = np.cumsum(sizes) - sizes, ends.flatten() if light else ends
                text = np.array(raw_a + raw_b, dtype=object)
                for i, j, score, swapped in _alike(a, b, x, y, threshold, edits, same, (raw_a, raw_b), ratio):
                    one, two = np.where(swapped, j + len(a), i), np.where(swapped, i, j + len(a))
                    # 1: an entry with itself; 2: entries of one name, whose ids have no order yet
                    kind = np.where(text[one] == text[two], np.where(same & (i == j), 1, 2), 0).astype(np.int32)
                    cuts = np.cumsum(sizes[one] * sizes[two]) // (1 << 16)
                    for part in np.split(np.arange(len(one)), np.nonzero(np.diff(cuts))[0] + 1):
                        if len(part):
                            p, q = one[part], two[part]
                            many = sizes[p] * sizes[q]
                            of = np.repeat(np.arange(len(part)), many)
                            k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                            u, v = flat.take(pa.array(starts[p][of] + k // sizes[q][of])), flat.take(pa.array(starts[q][of] + k % sizes[q][of]))
                            kinds = batch.column("type").take(pa.array(np.full(len(of), row)))
                            p, q, part = p[of], q[of], part[of]
                            yield pa.RecordBatch.from_arrays([kinds, names.take(pa.array(p)), names.take(pa.array(q)), pa.array(score[part]), u, v, pa.array(kind[part])], ["type", "name1", "name2", "similarity", "id1", "id2", "kind"])

    return run


def alike_pairs(named: DataFrame, threshold: float, edits: bool, ratio: Callable) -> DataFrame:
    """``id1, name1, id2, name2, type, similarity`` of all alike pairs of ``named`` (``id, name, type, n``, n of at most ``LONGEST`` letters).

    Entries of few ids are paired in the blocks, others by a join of their ids.
    """
    own = named.withColumn("own", F.monotonically_increasing_id())
    counts = named.groupBy("type", "name").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    entries = own.join(shuffled(counts), ["type", "name"]).groupBy("type", "name", "n", F.pmod("own", "chunks").alias("chunk")).agg(F.transform(F.collect_list(F.struct("id")), lambda s: s["id"]).alias("ids"))
    entries = materialize(entries.select("*", F.length("n").alias("x"), (F.size("ids") <= LIGHT).alias("light"), F.monotonically_increasing_id().alias("e")), "names-entries")
    group = ["type", "x", "light"]
    sizes = materialize(entries.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / ENTRIES).cast("int").alias("blocks")), "names-sizes")
    dealt = entries.join(shuffled(sizes), group).withColumn("block", F.pmod(F.xxhash64("name", "chunk"), "blocks").cast("int"))
    item = F.struct("name", "n", "e", F.when(F.col("light"), F.col("ids")).otherwise(F.array().cast(entries.schema["ids"].dataType)).alias("ids"))
    blocks = materialize(dealt.groupBy(*group, "block").agg(F.collect_list(item).alias("items")), "names-blocks")
    side = lambda *c: sizes.select("type", *(F.col(o).alias(n) for o, n in zip(("x", "light"), c, strict=False)), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(c[2]))
    meet = shuffled(side("x", "l1", "b1")).join(side("y", "l2", "b2"), "type").where("(x, l1, b1) <= (y, l2, b2)")
    meet = materialize(meet.where(matched_column(F.col("x"), F.col("y"), threshold, edits) <= F.least("x", "y")), "names-met")
    one, two = (blocks.select("type", F.col("x").alias(x), F.col("light").alias(x2), F.col("block").alias(b), F.col("items").alias(i)) for x, x2, b, i in (("x", "l1", "b1", "a"), ("y", "l2", "b2", "b")))
    keys = ["type", "x", "l1", "b1", "y", "l2", "b2"]
    both = shuffled(meet).join(shuffled(one), ["type", "x", "l1", "b1"]).join(shuffled(two), ["type", "y", "l2", "b2"])
    both = both.withColumn("same", F.expr("(x, l1, b1) = (y, l2, b2)"))
    tasks = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(meet.count() / 16))

    def compared(where: str, light: bool, end: T.DataType) -> DataFrame:
        kinds = {"type": named.schema["type"].dataType, "name1": T.StringType(), "name2": T.StringType(), "similarity": T.DoubleType(), "id1": end, "id2": end, "kind": T.IntegerType()}
        return both.where(where).repartition(tasks, *keys).select("type", "x", "y", "same", "a", "b").mapInArrow(_compared(threshold, edits, ratio, light), T.StructType([T.StructField(k, v) for k, v in kinds.items()]))

    few = compared("l1 and l2", True, named.schema["id"].dataType)
    many = compared("not (l1 and l2)", False, T.LongType()).withColumnsRenamed({"id1": "e1", "id2": "e2"})
    ids = entries.select("e", F.explode("ids").alias("id"))
    many = shuffled(many).join(shuffled(ids.withColumnsRenamed({"e": "e1", "id": "id1"})), "e1")
    many = shuffled(spread(many, "e2")).join(shuffled(ids.withColumnsRenamed({"e": "e2", "id": "id2"})), "e2")
    rows = few.unionByName(many.select(*few.columns)).where("kind = 0 or kind = 1 and id1 < id2 or kind = 2 and id1 <> id2")
    turned = (F.col("kind") == 2) & (F.col("id1") > F.col("id2"))
    return rows.select(F.when(turned, F.col("id2")).otherwise(F.col("id1")).alias("id1"), "name1", F.when(turned, F.col("id1")).otherwise(F.col("id2")).alias("id2"), "name2", "type", "similarity")
