"""Shared pieces of the text operators: Arrow mapping, row keys, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows handled at once inside a worker; bounds the Python objects alive, not the rows processed.
SLICE_ROWS = 512
#: A bitmap has 2**28 bits, by the upper bits of a key, gathered in pieces of 2**16.
SHIFT = 36


def arrow_schema(schema: StructType | str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return to_arrow_schema(schema)


def relax() -> None:
    """Gives freed memory back to the system: an idle worker shares its machine's memory with the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` over small slices given and returned as dicts of column lists."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the column lists form no cycles, and collections would scan every memo
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    out = fn(batch.slice(at, rows).to_pydict())
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:  # the worker goes on to other tasks, and a task's own functions do form cycles
            gc.enable()
            relax()

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Runs of equal ``keys`` in a sorted stream of batches, each as a dict of lists.

    The caller bounds the size of a run (blocks); a run may cross batches.
    """
    held: dict[str, list] | None = None
    last: tuple | None = None
    for batch in batches:
        cols = batch.to_pydict()
        key = list(zip(*(cols[k] for k in keys), strict=True))
        start = 0
        for i in range(1, len(key) + 1):
            if i < len(key) and key[i] == key[start]:
                continue
            part = {c: v[start:i] for c, v in cols.items()}
            if held is not None and last == key[start]:
                for c, v in part.items():
                    held[c].extend(v)
            else:
                if held is not None:
                    yield held
                held, last = part, key[start]
            start = i
    if held is not None:
        yield held


def crc_text(column: str) -> str:
    """SQL: unsigned crc32 of a column as text (null: of the empty text)."""
    return f"crc32(coalesce(cast({column} as string), ''))"


class TokenHashes:
    """64-bit hashes of words, remembered up to a bound and then forgotten."""

    def __init__(self, most: int = 400_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        get, known = self.known.get, self.known
        out = [get(w) for w in words]
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                out[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(out, dtype=np.uint64)


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that were not put into the bitmap."""
    place = (keys >> np.uint64(SHIFT)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the upper halves of ``key``, set in the workers; its size does not depend on the rows."""

    def by_piece(parts: list) -> pa.RecordBatch:
        place = np.unique(np.concatenate(parts))
        piece, bit = (place >> 16).astype(np.int64), (place & 65535).astype(np.uint16)
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        return pa.RecordBatch.from_arrays([pa.array(piece[edges[:-1]]), pa.array([bit[a:z].tobytes() for a, z in zip(edges, edges[1:])], type=pa.binary())], names=["piece", "bits"])

    def places(batches):  # noqa: ANN001, ANN202
        parts, size = [], 0
        for b in batches:
            parts.append((b.column(0).to_numpy().view(np.uint64) >> np.uint64(SHIFT)).astype(np.uint32))
            size += b.num_rows
            if size >= 2_000_000:
                yield by_piece(parts)
                parts, size = [], 0
        if size:
            yield by_piece(parts)

    def run(batches):  # noqa: ANN001, ANN202
        for group in groups(batches, ["piece"]):
            bits = np.zeros(65536, dtype=bool)
            bits[np.frombuffer(b"".join(group["bits"]), dtype=np.uint16)] = True
            yield pa.RecordBatch.from_arrays([pa.array([group["piece"][0]], type=pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], type=pa.binary())], names=["piece", "bits"])

    out = np.zeros(1 << (64 - SHIFT - 3), dtype=np.uint8)
    found = keys.select(F.col("key").cast("long")).mapInArrow(places, "piece long, bits binary").repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "piece long, bits binary").toArrow()
    for piece, part in zip(found.column("piece").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[piece * 8192 : (piece + 1) * 8192] = np.frombuffer(part, dtype=np.uint8)
    return out


@lru_cache(maxsize=4)
def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def broadcast(spark: SparkSession, value):  # noqa: ANN001, ANN201
    """Broadcast of a value whose size a parameter bounds (a tokenizer file, a model)."""
    return spark.sparkContext.broadcast(value)
