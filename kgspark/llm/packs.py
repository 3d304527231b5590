"""Columns of numbers packed into one compressed value.

Bytes of equal weight lie together, so the upper bytes of sorted keys and of small
numbers compress away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def pack(*columns: np.ndarray) -> bytes:
    """The columns, each of its own type and length."""
    head = ";".join(f"{c.dtype.str},{len(c)}" for c in columns).encode()
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    data = len(head).to_bytes(4, "little") + head + b"".join(planes)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    data = pa.Codec("zstd", 1).decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for part in data[4:at].decode().split(";"):
        kind, n = part.split(",")
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, dtype=np.uint8, count=int(n) * size, offset=at).reshape(size, int(n))
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += int(n) * size
    return out
