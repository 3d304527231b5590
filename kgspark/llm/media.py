"""Media columns: signature sniffing, structural checks and carving.

Aho-Corasick finds every magic sequence in one pass. A magic is only a
candidate; the format's validator walks the structure (chunk lengths, checksums,
end marks) and returns the length of a sound object or nothing. The object at
offset 0 corrects the declared type; sound objects inside it are carved.

Payloads are stored as 8-bit mono PCM in a RIFF/WAVE container, which keeps any
byte sequence of even length without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Payloads are filled with bytes of this value to a positive multiple of UNIT.
FILL, UNIT = 255, 576
#: End marks that are searched together with the magics (fixed values).
JPEG_END, PDF_END, PDF_TABLE, ZIP_END = b"\xff\xd9", b"%%EOF", b"startxref", b"PK\x05\x06"
#: Samples a second written to the container's header.
RATE = 8000


class Marks:
    """Places of the end marks that the search for magics also found; the first or last in a range by bisection."""

    def __init__(self, places: dict[bytes, list[int]]) -> None:
        self.places = places

    def first(self, mark: bytes, low: int) -> int:
        """Place of the first mark at or after ``low``, or -1."""
        own = self.places.get(mark, [])
        i = bisect_left(own, low)
        return own[i] if i < len(own) else -1

    def between(self, mark: bytes, low: int, high: int) -> bool:
        return low <= self.first(mark, low) < high


def _chunks(data: bytes, at: int, kind: bytes) -> tuple[int, list[bytes]] | None:
    """Size and chunk names of a RIFF object of ``kind`` whose declared length fits and is filled by its chunks."""
    if at + 12 > len(data) or data[at + 8 : at + 12] != kind:
        return None
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    if at + size > len(data):
        return None
    pos, seen = at + 12, []
    while pos + 8 <= at + size:
        name, length = struct.unpack_from("<4sI", data, pos)
        seen.append(name)
        pos += 8 + length + (length & 1)
    return (size, seen) if pos == at + size else None


def _wave(data: bytes, at: int, marks: Marks | None = None) -> int | None:
    """RIFF/WAVE: format before data."""
    found = _chunks(data, at, b"WAVE")
    return found[0] if found and found[1][:1] == [b"fmt "] and b"data" in found[1] else None


def _webp(data: bytes, at: int, marks: Marks) -> int | None:
    """RIFF/WEBP: begins with one of the three image chunks."""
    found = _chunks(data, at, b"WEBP")
    return found[0] if found and found[1][:1] in ([b"VP8 "], [b"VP8L"], [b"VP8X"]) else None


#: Bytes with their bits in the other order: Ogg's checksum has the polynomial of CRC-32, highest bit first.
_MIRROR = bytes(int(f"{byte:08b}"[::-1], 2) for byte in range(256))


def _ogg_crc(data: bytes) -> int:
    """CRC-32 with mirrored bits, begun at 0 and not inverted."""
    return int(f"{zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(data: bytes, at: int, marks: Marks) -> int | None:
    """Ogg: pages with right checksums from one that begins a stream to one that ends it."""
    pos = at
    while data[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(data):
        flags, segments = data[pos + 5], data[pos + 26]
        end = pos + 27 + segments + sum(data[pos + 27 : pos + 27 + segments])
        if end > len(data) or flags > 7 or pos == at and not flags & 2:
            return None
        if _ogg_crc(data[pos : pos + 22] + b"\0\0\0\0" + data[pos + 26 : end]) != struct.unpack_from("<I", data, pos + 22)[0]:
            return None
        if flags & 4:
            return end - at
        pos = end
    return None


def _mp4(data: bytes, at: int, marks: Marks) -> int | None:
    """MP4: boxes of printable names whose lengths follow each other, the movie's header and its media among them."""
    pos, seen = at, []
    while pos + 8 <= len(data):
        length, name = struct.unpack_from(">I4s", data, pos)
        if length < 8 or pos + length > len(data) or not (name.isalnum() and name.isascii()):
            break
        seen.append(name)
        pos += length
    return pos - at if seen[:1] == [b"ftyp"] and b"moov" in seen and {b"mdat", b"moof"} & set(seen) else None


def _png(data: bytes, at: int, marks: Marks) -> int | None:
    """PNG: chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        length, name = struct.unpack_from(">I4s", data, pos)
        end = pos + 12 + length
        if end > len(data) or first and (name != b"IHDR" or length != 13):
            return None
        if zlib.crc32(data[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if name == b"IEND":
            return end - at
        pos, first = end, False
    return None


def _gif(data: bytes, at: int, marks: Marks) -> int | None:
    """GIF: blocks of known kinds, sub-blocks closed by 0, then the trailer."""
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while pos < len(data):
        kind = data[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(data):
            flags = data[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return None
        while pos < len(data) and data[pos]:
            pos += data[pos] + 1
        pos += 1
    return None


def _jpeg(data: bytes, at: int, marks: Marks) -> int | None:
    """JPEG: marker segments by their lengths up to the scan, then the end mark."""
    pos = at + 2
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker, length = data[pos + 1], struct.unpack_from(">H", data, pos + 2)[0]
        if length < 2:
            return None
        pos += 2 + length
        if marker == 0xDA:
            end = marks.first(JPEG_END, pos)
            return end + 2 - at if end >= 0 else None
    return None


def _pdf(data: bytes, at: int, marks: Marks) -> int | None:
    """PDF: a version digit and an end-of-file mark after a cross-reference offset."""
    if not data[at + 5 : at + 6].isdigit():
        return None
    end = marks.first(PDF_END, at)
    return end + 5 - at if end > 0 and marks.between(PDF_TABLE, at, end) else None


def _gzip(data: bytes, at: int, marks: Marks) -> int | None:
    """GZIP: the member inflates and its checksum holds."""
    reader = zlib.decompressobj(31)
    try:
        step = at
        while not reader.eof and step < len(data):
            reader.decompress(data[step : step + 65536])
            step += 65536
    except zlib.error:
        return None
    return min(step, len(data)) - len(reader.unused_data) - at if reader.eof else None


def _zip(data: bytes, at: int, marks: Marks) -> int | None:
    """ZIP: a local header, and an end record whose directory offset and size agree."""
    end = marks.first(ZIP_END, at)
    if end < 0 or end + 22 > len(data):
        return None
    size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
    return end + 22 + comment - at if at + offset + size == end and end + 22 + comment <= len(data) else None


def _bmp(data: bytes, at: int, marks: Marks) -> int | None:
    """BMP: declared length fits, reserved words are 0 and the pixel offset lies inside."""
    if at + 26 > len(data):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", data, at + 2)
    return size if not reserved and header in (12, 40, 108, 124) and 14 + header <= offset <= size <= len(data) - at else None


#: Magic bytes, media type and validator of each format (fixed values).
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int, Marks], int | None]], ...] = (
    (b"RIFF", "audio/wav", _wave),
    (b"RIFF", "image/webp", _webp),
    (b"OggS", "application/ogg", _ogg),
    (b"ftyp", "video/mp4", _mp4),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"BM", "image/bmp", _bmp),
)


#: Bytes before a format's magic.
_BEFORE = {b"ftyp": 4}


@lru_cache(maxsize=1)
def _finder() -> ahocorasick.Automaton:
    """Magics and end marks as Latin-1 strings: one character for each byte."""
    a = ahocorasick.Automaton()
    for word in {magic for magic, _, _ in FORMATS} | {JPEG_END, PDF_END, PDF_TABLE, ZIP_END}:
        a.add_word(word.decode("latin-1"), word)
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every sound object, outer ones first; a format inside a found one of its own type counts too.

    One search finds magics and end marks, so a magic without its end costs a
    bisection, not another search to the end of the data.
    """
    places: dict[bytes, list[int]] = {}
    for end, word in _finder().iter(data.decode("latin-1")):
        places.setdefault(word, []).append(end + 1 - len(word))
    marks, out = Marks(places), []
    for magic, kind, valid in FORMATS:
        for at in places.get(magic, ()):
            at -= _BEFORE.get(magic, 0)
            length = valid(data, at, marks) if at >= 0 else None
            if length:
                out.append((at, length, kind))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def corrected(data: bytes, declared: str | None) -> tuple[str, list[tuple[int, int, str]]]:
    """The type that the structure proves (else the declared one) and the objects carved from inside."""
    found = sniff(data)
    whole = next((kind for at, _, kind in found if at == 0), declared or "application/octet-stream")
    return whole, [x for x in found if x[0] > 0]


def to_payload(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes filled up to a positive multiple of UNIT, and their number before."""
    raw = text.encode()
    return raw + bytes([FILL]) * (-len(raw) % UNIT if raw else UNIT), len(raw)


def to_wave(payload: bytes) -> bytes:
    """8-bit mono PCM in a RIFF/WAVE container."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def from_wave(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE container that ``to_wave`` or another writer made."""
    if not _wave(media, 0):
        raise ValueError("not a sound RIFF/WAVE object")
    pos = 12
    while True:
        name, length = struct.unpack_from("<4sI", media, pos)
        if name == b"data":
            return media[pos + 8 : pos + 8 + length]
        pos += 8 + length + (length & 1)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as stored media: ``doc_id, n_bytes, media, declared``.

    Null text counts as empty. One row for each row in; nulls in other columns,
    repeated rows and clashing names of further columns do not matter. Very long
    texts are stored whole; an empty table gives no rows.
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        made = [to_payload(t or "") for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [n for _, n in made], "media": [to_wave(p) for p, _ in made], "declared": ["application/octet-stream"] * len(made)}

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary, declared string")


def describe(media: bytes, declared: str | None) -> dict:
    """What the stored bytes show: payload digests, corrected type, carved objects."""
    kind, carved = corrected(media, declared)
    payload = from_wave(media) if kind == "audio/wav" else media
    parts = ";".join(f"{at}:{length}:{what}" for at, length, what in carved)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"type={kind};declared={declared or ''};samples={len(payload)};carved={len(carved)}" + (f";{parts}" if parts else ""),
    }


def inspect_media(media: DataFrame) -> DataFrame:
    """Read stored media back: digests, corrected type, carved objects. Null media count as empty bytes."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [describe(m or b"", d) for m, d in zip(cols["media"], cols["declared"], strict=True)]
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"]} | {k: [r[k] for r in rows] for k in names}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.map_batches(media.select("doc_id", "n_bytes", "media", "declared"), run, schema)
