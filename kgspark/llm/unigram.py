"""Count-only Viterbi: tokens of a unigram tokenizer without building its pieces.

An Aho-Corasick automaton names every vocabulary entry that ends at each
character; dynamic programming carries the best score, the piece count and
whether the last step was unknown. No back pointers and no strings are made.

Tie rules are those of the public ``tokenizers`` library's Unigram model with a
Metaspace pre-tokenizer (split, prefix always): a position keeps the candidate
that came first, begins are visited from left to right, and only a strictly
higher score replaces it; a character that is no entry itself steps with the
lowest score less ten; neighbouring unknown characters fuse and then fall back
to bytes if all their byte entries exist, else they count as one.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_model(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, of a sentencepiece file; kind: normal, byte, control or unknown."""
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(p.get_piece_size()):
        kind = "unknown" if p.is_unknown(i) else "control" if p.is_control(i) else "byte" if p.is_byte(i) else "normal"
        out.append((p.id_to_piece(i), p.get_score(i), kind))
    return out


class Counter:
    """Token counts and best scores for one vocabulary."""

    #: Words remembered in each of two generations; bounds memory, not input.
    MEMO = 150_000

    def __init__(self, vocab: list[tuple[str, float, str]]) -> None:
        self.vocab = vocab
        self.lowest = min((s for _, s, _ in vocab), default=0.0)
        self.bytes_known = sum(kind == "byte" for _, _, kind in vocab) == 256
        self.find = ahocorasick.Automaton()
        for piece, score, _ in vocab:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.memo: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def __reduce__(self) -> tuple:
        return Counter, (self.vocab,)

    def word(self, word: str) -> tuple[int, float]:
        """(tokens, score) of one pre-token, by the tie rules above."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.find):
            for end, entry in self.find.iter(word):
                ends[end].append(entry)
        unknown = self.lowest - UNKNOWN_PENALTY
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        fused = [False] * (n + 1)  # the best way here ends in an unknown character
        for end in range(n):
            best, at, known = None, 0, False
            entries = ends[end]
            if len(entries) > 1:
                entries.sort(reverse=True)  # the longest began first
            for length, value in entries:
                known = known or length == 1
                total = score[end + 1 - length] + value
                if best is None or total > best:
                    best, at = total, length
            if not known and (best is None or score[end] + unknown > best):
                best, at = score[end] + unknown, 0
            score[end + 1] = best
            if at:
                count[end + 1] = count[end + 1 - at] + 1
            else:
                fused[end + 1] = True
                if self.bytes_known:
                    count[end + 1] = count[end] + len(word[end].encode("utf-8", "replace"))
                else:
                    count[end + 1] = count[end] + (not fused[end])
        return count[n], score[n]

    def _resolve(self, word: str) -> tuple[int, float]:
        found = self.older.get(word) or self.word(word)
        if len(word) <= 64:
            if len(self.memo) >= self.MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[word] = found
        return found

    def text(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a text: each space begins a pre-token."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE_MARK)
        if marked[0] != SPACE_MARK:
            marked = SPACE_MARK + marked
        words = [SPACE_MARK + w for w in marked[1:].split(SPACE_MARK)]
        get, resolve = self.memo.get, self._resolve
        parts = [get(w) or resolve(w) for w in words]
        return sum([p[0] for p in parts]), sum([p[1] for p in parts])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_model(path))


def read_unigram(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, of a ``tokenizers`` JSON file with a Unigram model."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "Unigram":
        raise ValueError(f"a {model['type']} model is no Unigram model")
    names = {f"<0x{b:02X}>" for b in range(256)} if model.get("byte_fallback") else set()
    kind = lambda i, piece: "unknown" if i == model.get("unk_id") else "byte" if piece in names else "normal"
    return [(piece, score, kind(i, piece)) for i, (piece, score) in enumerate(model["vocab"])]


def count_tokens(spark: SparkSession, docs: DataFrame, model: str | list[tuple[str, float, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact token count and best path score of every document.

    ``model``: a sentencepiece file, or a vocabulary as ``read_unigram`` gives.
    One row out for each row in. Null and empty texts have no tokens and score
    0. Null ids and repeated rows pass through; other columns are not carried, so
    their names cannot clash. Very long texts are read whole, an empty table gives
    no rows.
    Scores of a text are the sums of its words' scores, left to right. The
    vocabulary is as large as the tokenizer file, and is broadcast.
    """
    vocab = counter(model).vocab if isinstance(model, str) else model
    held = common.broadcast(spark, vocab)
    name = hashlib.sha256(repr(vocab).encode("utf-8", "replace")).hexdigest()

    def run(cols: dict[str, list]) -> dict[str, list]:
        count = _worker_counter(name, held).text
        rows = [count(t or "") for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_tokens": [r[0] for r in rows], "best_score": [r[1] for r in rows]}

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_tokens long, best_score double")


_KEPT: dict[str, Counter] = {}


def _worker_counter(name: str, held) -> Counter:  # noqa: ANN001
    """One counter in a Python worker, kept from task to task as long as the vocabulary of that digest is asked for."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Counter(held.value)
    return _KEPT[name]
