"""Pluggable language-model steps, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Extractor(Protocol):
    """Replies in the graph tuple format; ``known`` names what earlier passes found."""

    def extract(self, text: str, types: list[str], known: list[str]) -> str: ...

    def more(self, text: str, known: list[str]) -> str: ...


class Embedder(Protocol):
    dim: int

    def embed(self, text: str) -> list[float]: ...


class CapitalExtractor:
    """Capitalised words as entities, neighbours in a sentence as relationships."""

    NAME = re.compile(r"\b[^\W\d_a-z][^\W\d_]{2,}")

    def extract(self, text: str, types: list[str], known: list[str]) -> str:
        kind = types[0] if types else "TERM"
        out = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            names = list(dict.fromkeys(self.NAME.findall(sentence)))
            out += [f'("entity"|||{n}|||{kind}|||{sentence[:80]})' for n in names if n not in known]
            out += [f'("relationship"|||{a}|||{b}|||{sentence[:80]}|||5)' for a, b in zip(names, names[1:], strict=False)]
        return "\n".join([*out, "<COMPLETE>"])

    def more(self, text: str, known: list[str]) -> str:
        return "N"


class HashEmbedder:
    """Signed feature hashing of words; the same text has the same vector everywhere."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()


def first_sentence(prompt: str) -> str:
    """Extractive stand-in for a generator: the first sentence, at most 200 characters."""
    return re.split(r"(?<=[.!?])\s+", prompt.strip())[0][:200]


def paced(call: Callable[[str], str], spacing: float = 1 / 60, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call`` with a least spacing and retries with doubling waits; the last error is raised."""
    last = [0.0]

    def run(prompt: str) -> str:
        for attempt in range(tries):
            gap = last[0] + spacing - time.monotonic()
            if gap > 0:
                sleep(gap)
            last[0] = time.monotonic()
            try:
                return call(prompt)
            except Exception:
                if attempt == tries - 1:
                    raise
                sleep(wait * 2**attempt)
        raise RuntimeError("no tries")

    return run


def prompt(task: str, **parts: str) -> str:
    """A prompt from a task line and named parts, in the order given."""
    return "\n\n".join([task, *(f"{k.replace('_', ' ').capitalize()}:\n{v}" for k, v in parts.items())])
