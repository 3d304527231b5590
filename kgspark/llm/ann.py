"""Approximate nearest neighbours on shifted space-filling curves.

Unit vectors are turned by random rotations; some coordinates of each turn,
shifted at random, are ordered along a Hilbert curve, finely enough that vectors
which differ only in their last float bits keep an order of their own on every
curve. Each curve is range-partitioned and sorted; a query's candidates are the
``window`` rows on either side of it on every curve, each scored by the exact
cosine, and the lists of all curves merge. Work is queries x curves x window,
whatever the number of rows.

A range is read as a stream in key order, so a task's memory is bounded by the
window and a batch. A query near the border of a range also visits the next one,
where its key sorts before or after all rows. Equal vectors are one class that
carries its ``k`` + 1 smallest ids: enough for any query, whatever the number of
copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from kgspark.runtime import materialize

from . import common


@dataclass(frozen=True)
class Settings:
    k: int = 5
    #: Curves, and rows on either side of a query that are its candidates on each: recall against work.
    curves: int = 40
    window: int = 256
    #: Coordinates and bits a coordinate of a curve; single-precision vectors differ within 40 bits of the range.
    coords: int = 8
    bits: int = 40
    #: Ranges of a curve are tasks, not limits: of about so many rows, at most so many ranges.
    range_rows: int = 8192
    ranges: int = 512
    #: Parts of a range (a query in an outer part visits the next range too), and sampled rows for each border.
    parts: int = 8
    border_rows: int = 64
    #: Rows of the sample on which the centre and the scales are fitted; the index itself holds every row.
    sample: int = 10_000
    seed: int = 3


def _turned(points: np.ndarray, bits: int) -> np.ndarray:
    """Coordinates whose bits, dealt in turn from the highest on, are the position on the Hilbert curve."""
    x = points.astype(np.uint64).T.copy()
    m = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        q, p = np.uint64(level), np.uint64(level - 1)
        for i in range(m):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    turn, level = np.zeros(x.shape[1], dtype=np.uint64), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[m - 1] & np.uint64(level)) != 0, np.uint64(level - 1), np.uint64(0))
        level >>= 1
    x ^= turn
    return x


def hilbert_bytes(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve as rows of bytes in the order of the curve, for any number of bits."""
    x = _turned(points, bits)
    steps = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((x.T[:, None, :] >> steps[None, :, None]) & np.uint64(1)).astype(np.uint8).reshape(x.shape[1], -1), axis=1)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) of ``bits`` bits a coordinate, together at most 64."""
    x = _turned(points, bits)
    m = len(x)
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


@dataclass
class Curves:
    centre: np.ndarray
    turns: np.ndarray  # curve x dim x coordinate
    low: np.ndarray
    width: np.ndarray
    shift: np.ndarray
    bits: int

    def keys(self, vectors: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """One key of bytes for each vector and curve; ``tie``, hashed for each curve, splits what equals in all bits."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.centre
        out, top = [], 1 << self.bits
        for c, turn in enumerate(self.turns):
            y = (unit @ turn - self.low[c]) / self.width[c] * 0.9 + self.shift[c] * 0.1
            place = hilbert_bytes(np.clip((y * top).astype(np.int64), 0, top - 1), self.bits)
            mixed = (tie.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * c) >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(-1, 2)
            whole = np.ascontiguousarray(np.hstack([place, mixed]))
            out.append(whole.view(f"S{whole.shape[1]}").reshape(-1))
        return np.stack(out, axis=1)


def fit(sample: np.ndarray, s: Settings) -> Curves:
    """Random rotations; centre and scales from the sample."""
    rng = np.random.default_rng(s.seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre, dim = unit.mean(axis=0), sample.shape[1]
    coords = min(s.coords, dim)
    each = dim // coords  # curves of one rotation look along different axes
    turns, axes = [], np.zeros((0, 0))
    for c in range(s.curves):
        if c % each == 0:
            axes = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        turns.append(axes[:, c % each * coords : (c % each + 1) * coords])
    turned = np.stack(turns)
    y = np.einsum("nd,cdm->cnm", unit - centre, turned)
    low, high = np.quantile(y, 0.001, axis=1), np.quantile(y, 0.999, axis=1)
    return Curves(centre, turned, low, np.maximum(high - low, 1e-9), rng.random((s.curves, coords)), s.bits)


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components present and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _raw(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Vectors as rows of doubles, each scaled by a power of two to at most 1: exact, and squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1]) if rows.size else rows


def _blobs(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values; cheaper to move than lists of numbers."""
    if not len(rows):
        return pa.array([], type=pa.binary())
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // len(rows)
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _from_blobs(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    width = dim * np.dtype(kind).itemsize
    fixed = column.cast(pa.binary(width))
    return np.frombuffer(fixed.buffers()[1], dtype=np.uint8)[fixed.offset * width : (fixed.offset + len(fixed)) * width].view(kind).reshape(-1, dim)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision; each depends on its two rows only."""
    return (q * c).sum(axis=-1) / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((c * c).sum(axis=-1)))


#: Rows whose keys are made at once in a worker; bounds memory, not input.
BLOCK = 4096
#: Cosines by matrix product are this close to the exact ones.
NEAR = 1e-13


def best(query: np.ndarray, rows: np.ndarray, unit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and exact cosines of the k best rows, ties to the smaller id; every row that may be among them is scored exactly."""
    near = unit @ (query / np.linalg.norm(query))
    some = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - 2 * NEAR) if len(near) > k else np.arange(len(near))
    score = _exact(query, rows[some])
    order = np.lexsort((ids[some], -score))[:k]
    return some[order], score[order]


class Window:
    """The rows of one range of a curve, read in key order, and the queries whose window is not complete yet."""

    def __init__(self, width: int, k: int) -> None:
        self.width, self.k = width, k
        self.first = 0  # place of the first row that is held
        self.rows: list[np.ndarray] = []  # c1, c2, id, vector, unit vector
        self.waiting: list[tuple[int, int, int, np.ndarray]] = []  # place, q1, q2, vector

    def add(self, v1: np.ndarray, v2: np.ndarray, ids: np.ndarray, m: np.ndarray, asked: np.ndarray, visitor: np.ndarray) -> None:
        own = ~visitor
        held = len(self.rows[0]) if self.rows else 0
        place = self.first + held + np.cumsum(own) - own
        unit = m[own] / np.linalg.norm(m[own], axis=1, keepdims=True)
        new = [v1[own], v2[own], ids[own], m[own], unit]
        self.rows = [np.concatenate(x) for x in zip(self.rows, new, strict=True)] if self.rows else new
        self.waiting += [(int(place[i]), int(v1[i]), int(v2[i]), m[i]) for i in np.flatnonzero(asked).tolist()]

    def take(self, ended: bool) -> pa.RecordBatch:
        """Lists of the queries that have seen all their candidates; rows that no query needs go."""
        end = self.first + len(self.rows[0])
        n = len(self.waiting) if ended else sum(p + self.width < end for p, *_ in self.waiting)
        parts = []
        for p, q1, q2, vector in self.waiting[:n]:
            low, high = max(0, p - self.width - self.first), p + self.width + 1 - self.first
            c1, c2, ids, rows, unit = (x[low:high] for x in self.rows)
            if len(ids):
                top, score = best(vector, rows, unit, ids, self.k)
                parts.append((np.full(len(top), q1), np.full(len(top), q2), c1[top], c2[top], score))
        del self.waiting[:n]
        need = (self.waiting[0][0] if self.waiting else end) - self.width
        if need > self.first:
            self.rows = [x[need - self.first :] for x in self.rows]
            self.first = need
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64,) * 4 + (np.float64,)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q1", "q2", "c1", "c2", "score"])


def nearest(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query row's ``k`` nearest other rows: ``query_id, rank, vec_id, score``.

    ``is_query`` is SQL over ``vec_id``. Nearness is the cosine in double
    precision, ties to the smaller id; fewer candidates give fewer rows. Rows
    with a null id take no part, nor do vectors that are null, empty, zero, or
    hold null or non-finite components, nor those whose length is not the most
    common one (the larger on ties). A row that repeats a query's id is not its
    candidate. Empty input gives no rows; other columns are not carried.
    """
    element = vectors.schema[vector_col].dataType.elementType.typeName()
    kind = "float" if element == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == lengths["d"]).withColumns({"v1": F.xxhash64("v"), "v2": F.xxhash64(F.lit(7), "v")})

    by_vector = SqlWindow.partitionBy("v1", "v2").orderBy("vec_id")
    few = rows.select("v1", "v2", "vec_id").distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= s.k + 1)  # cut on both sides of the shuffle
    ids = few.groupBy("v1", "v2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    queries = materialize(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v1", "v2").distinct(), "ann-queries")
    asked = queries.select("v1", "v2", F.lit(True).alias("asked")).distinct()
    shapes = rows.groupBy("v1", "v2").agg(F.first("v").alias("v"))
    classes = materialize(shapes.join(ids, ["v1", "v2"]).join(asked, ["v1", "v2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "ann-classes")

    total = classes.count()
    sample = _scaled(_raw(classes.orderBy("v2", "v1").limit(s.sample).select("v").toArrow().column(0).combine_chunks()))
    dtype, dim = ("f4" if kind == "float" else "f8"), lengths["d"]
    curves = common.broadcast(spark, fit(sample, s))
    ranges = max(1, min(s.ranges, total // s.range_rows))
    cuts = ranges * s.parts

    def keyed(batches):  # noqa: ANN001, ANN202
        for b in batches:
            keys = curves.value.keys(_scaled(_raw(b.column(0))), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))), _blobs(keys.reshape(-1))], names=["curve", "key"])

    def borders(part: pa.Table) -> pa.Table:
        keys = np.sort(np.array(part.column("key").to_pylist(), dtype=bytes))
        at = [keys[i * len(keys) // cuts] for i in range(1, cuts)]
        return pa.table({"curve": part.column("curve")[:1], "cuts": pa.array([[bytes(x) for x in at]], type=pa.list_(pa.binary()))})

    every = max(1, total // (s.border_rows * cuts))
    some = classes.where(F.pmod(F.col("v2"), F.lit(every)) == 0).select("v", "v1").mapInArrow(keyed, "curve int, key binary")
    bounds = {r["curve"]: np.array([bytes(x) for x in r["cuts"]], dtype=bytes) for r in some.groupBy("curve").applyInArrow(borders, "curve int, cuts array<binary>").collect()}
    held = common.broadcast(spark, [bounds.get(c, np.array([], dtype=bytes)) for c in range(s.curves)])
    place = f"curve int, part int, key binary, v1 long, v2 long, id long, v binary, asked boolean, visitor boolean"
    placed_schema = common.arrow_schema(place)

    def placed(batches):  # noqa: ANN001, ANN202
        """Every class once a curve, and each asked class near a border once more for the next range."""
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                raw = _raw(b.column("v"))
                keys = curves.value.keys(_scaled(raw), b.column("v1").to_numpy())
                asked_rows = np.flatnonzero(b.column("asked").to_numpy(zero_copy_only=False))
                for c, cut in enumerate(held.value):
                    inner = np.searchsorted(cut, keys[:, c], side="right")
                    own, outer = inner // s.parts, inner[asked_rows] % s.parts
                    before = asked_rows[(outer == 0) & (own[asked_rows] > 0)]
                    after = asked_rows[(outer == s.parts - 1) & (own[asked_rows] < ranges - 1)]
                    take = np.concatenate([np.arange(len(keys)), before, after])
                    where = np.concatenate([own, own[before] - 1, own[after] + 1]).astype(np.int32)
                    cols = [b.column(x).take(pa.array(take)) for x in ("v1", "v2", "id", "asked")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), c, dtype=np.int32)), pa.array(where), _blobs(keys[take, c]), *cols[:3], _blobs(raw[take]), cols[3], pa.array(np.arange(len(take)) >= len(keys))], schema=placed_schema)

    def search(batches):  # noqa: ANN001, ANN202
        """Sorted by curve, range and key: windows slide over the rows."""
        name, window = None, None
        for b in batches:
            group = b.column("curve").to_numpy().astype(np.int64) * ranges + b.column("part").to_numpy()
            cols = [b.column(x).to_numpy(zero_copy_only=False) for x in ("v1", "v2", "id")]
            m, flags = _scaled(_from_blobs(b.column("v"), dtype, dim)), [b.column(x).to_numpy(zero_copy_only=False) for x in ("asked", "visitor")]
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if group[a] != name:
                    if window:
                        yield window.take(True)
                    name, window = group[a], Window(s.window, s.k + 1)
                window.add(*(x[a:z] for x in (*cols, m, *flags)))
                yield window.take(False)
        if window:
            yield window.take(True)

    spread = classes.select("v1", "v2", F.col("ids")[0].alias("id"), "v", "asked").mapInArrow(placed, place)
    hits = spread.repartition("curve", "part").sortWithinPartitions("curve", "part", "key").mapInArrow(search, "q1 long, q2 long, c1 long, c2 long, score double")
    merged = hits.groupBy("q1", "q2", "c1", "c2").agg(F.max("score").alias("score"))
    named = merged.join(ids.select(F.col("v1").alias("c1"), F.col("v2").alias("c2"), "ids"), ["c1", "c2"])
    nearest_first = SqlWindow.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0])
    named = named.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= s.k + 1)
    options = queries.join(named.withColumnsRenamed({"q1": "v1", "q2": "v2"}), ["v1", "v2"]).select("query_id", "v1", "v2", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    in_order = SqlWindow.partitionBy("query_id", "v1", "v2").orderBy(F.desc("score"), "vec_id")
    return options.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    return hit.count() / max(1, exact.count())
