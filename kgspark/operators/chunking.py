"""Greedy paragraph packing of documents into overlapping chunks.

An order-dependent state machine for each document, so it runs in Python over
Arrow batches; documents are independent and stay in their partitions.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ChunkSettings:
    size: int = 1000
    overlap: int = 300
    least: int = 100


def tokens(text: str) -> int:
    return len(text) // 4


def rank_counter(path: str, pattern: str) -> Callable[[], Callable[[str], int]]:
    """Maker of a byte-level BPE counter from a rank file; a text that it cannot encode counts as ``tokens``."""

    def make() -> Callable[[str], int]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def count(text: str) -> int:
            try:
                return len(encoding.encode_ordinary(text))
            except Exception:  # noqa: BLE001
                return tokens(text)

        return count

    return make


def chunks(text: str, s: ChunkSettings = ChunkSettings(), count: Callable[[str], int] = tokens) -> list[tuple[str, int | None, int | None]]:
    """(chunk, start, end) of one document, sized by ``count``.

    Paragraphs are packed while they fit. On overflow a chunk of at least
    ``least`` tokens is emitted and its tail carried over; a shorter one is
    dropped, as its source rule has it. A paragraph over the size is packed by
    sentences. The last chunk needs ``least`` tokens. A chunk is sought from where
    it can begin, so of equal passages each gets its own place; offsets are null
    where white space was normalised, so that the chunk is no substring.
    """
    out: list[tuple[str, int | None, int | None]] = []
    current, sought = "", 0

    def emit(chunk: str) -> None:
        nonlocal sought
        at = text.find(chunk, sought)
        out.append((chunk, at, at + len(chunk)) if at >= 0 else (chunk, None, None))
        if at >= 0:
            sought = at + len(chunk)

    for paragraph in (p.strip() for p in re.split(r"\n\n+", text)):
        if not paragraph:
            continue
        joined = f"{current}\n\n{paragraph}" if current else paragraph
        if count(joined) <= s.size:
            current = joined
            continue
        carried = ""
        if current and count(current) >= s.least:
            emit(current)
            n = count(current)
            carried = current[len(current) - int(len(current) * s.overlap / n) :] if n > s.overlap else current
            sought -= min(len(carried), sought)
        if count(paragraph) <= s.size:
            current = f"{carried}\n\n{paragraph}" if carried else paragraph
        else:
            current = ""
            for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
                packed = f"{current} {sentence}" if current else sentence
                if current and count(packed) > s.size:
                    emit(current)
                    current = sentence
                else:
                    current = packed
    if current and count(current) >= s.least:
        emit(current)
    return out


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: ChunkSettings = ChunkSettings(), make: Callable[[], Callable[[str], int]] = lambda: tokens) -> DataFrame:
    """Text units ``chunk_id, document_id, ordinal, text, start_char, end_char``; null text has none. ``make`` builds the token counter of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make()
        for pdf in batches:
            rows = [
                (f"{i}_chunk_{k}", str(i), k, c, a, b)
                for i, t in zip(pdf[id_col], pdf[text_col], strict=True)
                for k, (c, a, b) in enumerate(chunks(t or "", settings, count))
            ]
            out = pd.DataFrame(rows, columns=["chunk_id", "document_id", "ordinal", "text", "start_char", "end_char"])
            yield out.astype({"ordinal": "int32", "start_char": "Int32", "end_char": "Int32"})

    return docs.select(id_col, text_col).mapInPandas(run, "chunk_id string, document_id string, ordinal int, text string, start_char int, end_char int")


def count_tokens(docs: DataFrame, make: Callable[[], Callable[[str], int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens`` by a counter made once a partition; null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make()
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "n_tokens": [count(t or "") for t in pdf[text_col]]}).astype({"n_tokens": "int32"})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, n_tokens int")
