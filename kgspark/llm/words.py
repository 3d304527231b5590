"""Words of whole texts as bytes: one translation and one split in C, in pieces of bounded size.

A class of characters that holds all or none of the code points from U+0080 on
can be read from UTF-8 bytes: every byte of such a code point is above 0x7F.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa

#: A text is split in pieces of about so many bytes, so that no list holds all words of a very long text.
PIECE = 1 << 20
_LOWER = bytes(range(256)).lower()


def _table(kept: bytes) -> bytes:
    """A-Z become a-z, kept bytes stay, all others become blanks."""
    return bytes(b if b in kept else 32 for b in _LOWER)


_LETTERS, _HIGH = string.ascii_lowercase.encode(), bytes(range(0x80, 0x100))
#: Letters a-z and everything from U+0080 on (UTF-8).
TERMS = _table(_LETTERS + _HIGH)
#: The same with 0-9 (UTF-8).
WORDS = _table(_LETTERS + string.digits.encode() + _HIGH)
#: Letters a-z and U+00C0 to U+00FF, of texts encoded as Latin-1 where other code points are ``?``.
LATIN = _table(_LETTERS + bytes(range(0xC0, 0x100)))


def pieces(data: bytes, table: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists; every word is whole, however long."""
    data = data.translate(table)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def binary(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def utf8(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary()).cast(pa.string())
