"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
vocabulary entry costs one hash, one displacement and one comparison. Tier two
merges the bytes of all other pre-tokens with a heap over a doubly linked list,
lowest rank first and leftmost on ties, which is the order of the rank files'
own library. No special tokens exist here.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

M64 = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
#: White space as the pattern's own library reads ``\s``; fixed value (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    out = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


class PerfectHash:
    """Minimal perfect hash by hash and displace; ``slot(key)`` is in [0, n).

    Buckets of two or more keys store the first displacement that sends their
    keys to free slots; buckets of one key store a free slot itself, as a
    negative number. Keys outside the set get an arbitrary slot, so callers compare.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        self.n = n = max(1, len(keys))
        self.buckets = max(1, -(-n // per_bucket))
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("two keys share a 64-bit hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.zeros(n, dtype=bool)
        self.at = [0] * len(keys)
        disp = [0] * self.buckets
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            size = int(sizes[b])
            if size < 2:
                break
            members = order[starts[b] : starts[b] + size]
            base = 0
            while True:
                slots = self._slots(hashes[members][None, :], (tries + np.uint64(base))[:, None])
                free = ~taken[slots].any(axis=1)
                for row in np.flatnonzero(free):
                    if len(set(slots[row].tolist())) == size:
                        break
                else:
                    base += len(tries)
                    continue
                disp[b] = base + int(row)
                taken[slots[row]] = True
                for m, s in zip(members.tolist(), slots[row].tolist(), strict=True):
                    self.at[m] = s
                break
        free_slots = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):
            m, s = int(order[starts[b]]), next(free_slots)
            disp[b], self.at[m] = -1 - s, s
        self.disp = disp

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(GOLDEN))) * np.uint64(MIX)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.disp[h % self.buckets]
        if d < 0:
            return -1 - d
        return ((((h ^ (d * GOLDEN & M64)) * MIX & M64) >> 32)) % self.n


def _class(category: str, stop: int) -> str:
    """Members of a general category below ``stop``, as the inside of a character class."""
    return "".join(chr(c) for c in range(stop) if unicodedata.category(chr(c))[0] == category)


#: Below this code point all libraries agree on letters and numbers, and the standard ``re`` can split.
LATIN_END = 0x250
BEYOND_LATIN = re.compile(f"[^\0-{chr(LATIN_END - 1)}]").search


class Splitter:
    """Pre-tokens of a text. The public pattern has a faster form for Latin text."""

    def __init__(self, pattern: str) -> None:
        explicit = pattern.replace("[^\\s", "[^" + SPACE).replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")
        self.any = regex.compile(explicit).findall
        self.latin = None
        if pattern == public_tokenizers.PATTERN:
            letters, numbers = _class("L", LATIN_END), _class("N", LATIN_END)
            space = "\\t-\\r \\x85\\xa0"
            self.latin = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def __call__(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or not BEYOND_LATIN(text)):
            return self.latin(text)
        return self.any(text)


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    #: Pre-tokens remembered in each of two generations; the older one is then forgotten. Bounds memory, not input.
    MEMO = 150_000

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys: list[bytes] = [b""] * self.hash.n
        self.ids: list[int] = [-1] * self.hash.n
        for key, slot in zip(keys, self.hash.at, strict=True):
            self.keys[slot], self.ids[slot] = key, ranks[key]
        self.ranks = ranks
        self.tokens = {i: k for k, i in ranks.items()}
        self.pattern = pattern
        self._fresh()

    def _fresh(self) -> None:
        self.split = Splitter(self.pattern)
        self.memo: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "older")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._fresh()

    def whole(self, piece: bytes) -> int:
        """The id of a pre-token that is a vocabulary entry, else -1."""
        slot = self.hash.slot(piece)
        return self.ids[slot] if self.keys[slot] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: merges by rank over linked bytes."""
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        get, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the part here joined with the next one
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:
                continue  # one of the two parts has changed since
            mid = end[i]
            end[i] = stop = end[mid]
            pair[mid] = pair[i] = -1
            if stop < n:
                before[stop] = i
                pair[i] = r = get(piece[i : end[stop]], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            if (p := before[i]) >= 0:
                pair[p] = r = get(piece[p:stop], -1)
                if r >= 0:
                    push(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            stop = end[i]
            if (r := get(piece[i:stop])) is None:
                raise ValueError(f"byte {piece[i]} is not in the vocabulary")
            out.append(r)
            i = stop
        return out

    def word(self, word: str) -> list[int]:
        piece = word.encode()
        whole = self.whole(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.word, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _resolve(self, word: str) -> tuple[int, str, bytes]:
        if found := self.older.get(word):
            self.memo[word] = found
            return found
        ids = self.word(word)
        found = len(ids), ",".join(map(str, ids)), self.decode(ids)
        if len(word) <= 64:
            if len(self.memo) >= self.MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[word] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count, sha256 of the comma-joined ids, sha256 of the bytes decoded from the ids."""
        resolve = self._resolve
        parts = [self.memo.get(w) or resolve(w) for w in self.split(text)]
        joined = ",".join([p[1] for p in parts])
        decoded = b"".join([p[2] for p in parts])
        return sum([p[0] for p in parts]), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(parse_ranks(common.read_file(path)), pattern)


def encode_documents(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids and decoded text of every document (``digest``: their hashes).

    Null text counts as empty: no ids, and hashes of nothing. Null ids and
    repeated rows pass through, one row out for each row in; an empty table gives
    an empty result. Very long texts are read whole. Other columns are not
    carried, so their names cannot clash.
    The codec is as large as the tokenizer file, and is broadcast.
    """
    held = common.broadcast(spark, codec(ranks_path, pattern))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, n_tokens long, ids array<int>, decoded string"

    def run(cols: dict[str, list]) -> dict[str, list]:
        c = held.value
        texts = [t or "" for t in cols["text"]]
        if digest:
            rows = list(map(c.digest, texts))
            return {"doc_id": cols["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}
        ids = list(map(c.encode, texts))
        return {"doc_id": cols["doc_id"], "n_tokens": list(map(len, ids)), "ids": ids, "decoded": [c.decode(i).decode("utf-8", "replace") for i in ids]}

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
