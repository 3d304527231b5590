"""Secret scans with one combined deterministic automaton.

All rules' expressions are compiled into one minimal automaton, and each text's
UTF-8 bytes pass through it once: that pass yields the spans of all rules,
leftmost and longest. Least lengths that would multiply the states of all rules
(a value's 8 characters, a key's 36) are checks on the spans.

A private key is two rules, its first and its last line. What lies between is
checked from one to the other, which is linear: a first line cannot lie in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .automaton import Automaton

VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
PEM, PEM_END = "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "-----END (?:[A-Z]+ )*PRIVATE KEY-----"
#: All that may stand between the two (with the escaped line ends of JSON), and the base64 lines of a key without a last line.
_PEM_BODY = re.compile(rb"(?:[A-Za-z0-9+/=:,\\\x09\x0a\x0d\x20]|-[A-Za-z0-9])*")
_PEM_LINES = re.compile(rb"(?:(?:\x0d?\x0a|\\n)[A-Za-z0-9+/=]{16,})*")
_ASSIGN_VALUE = re.compile((ASSIGN + f"({VALUE}+)").encode())


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # matched leftmost and longest
    passes: Callable[[bytes], bool]
    base: bool = False


def _long_value(span: bytes) -> bool:
    found = _ASSIGN_VALUE.fullmatch(span)
    return bool(found) and len(found[1]) >= 8


#: Base kinds in their listed order, then kinds that the method adds. Runs of hex digits below 16 never pass, and are no matches.
RULES = (
    Rule("assign", ASSIGN + VALUE + "+", _long_value, True),
    Rule("access", "AKIA[A-Z0-9]+", lambda s: len(s) >= 16, True),
    Rule("hex", "[0-9a-f]{16,}", lambda s: len(s) >= 32, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", lambda s: len(s) == 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", lambda s: len(s) >= 15),
    Rule("pem", PEM, lambda s: True),
)
_KEY = next(k for k, r in enumerate(RULES) if r.kind == "pem")


class Scanner:
    """The combined automaton of the rules and the last line of a private key.

    With these rules it has 1,509 states of 49 columns (under 1 MB of references)
    and is built in about a second, once in each worker process.
    """

    def __init__(self) -> None:
        self.all = Automaton([*(r.pattern for r in RULES), PEM_END])

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, sorted."""
        data = text.encode()
        spans = self.all.spans(data)
        if not spans:
            return []
        last = {a: b for a, k, b in spans if k == len(RULES)}
        found, done = [], 0
        for a, k, b in sorted(spans):
            if k == _KEY:
                if a < done:
                    continue
                b = done = last.get(_PEM_BODY.match(data, b).end()) or _PEM_LINES.match(data, b).end()
                found.append((a, k, b))
            elif k < _KEY and RULES[k].passes(data[a:b]):
                found.append((a, k, b))
        if found and len(data) != len(text):
            found = [(len(data[:a].decode()), k, len(data[:b].decode())) for a, k, b in found]
        return sorted(found)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in found)


def redact(text: str, mark: str = "[{kind}]") -> str:
    """The text with every span replaced; spans that overlap become one mark of the first kind."""
    out, done = [], 0
    found = scanner().find(text)
    i = 0
    while i < len(found):
        a, k, b = found[i]
        i += 1
        while i < len(found) and found[i][0] < b:
            b = max(b, found[i][2])
            i += 1
        out += [text[done:a], mark.format(kind=RULES[k].kind.upper())]
        done = b
    return "".join(out) + text[done:] if out else text


def find_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of secrets in every document.

    One row out for each row in. Null text counts as empty: zero counts and no
    spans. Null ids and repeated rows pass through; equal texts give equal
    values; other columns are not carried, so their names cannot clash. Very long
    texts are read whole, an empty table gives no rows. Offsets are code points,
    ends exclusive.
    """
    base = [k for k, r in enumerate(RULES) if r.base]

    def run(cols: dict[str, list]) -> dict[str, list]:
        find = scanner().find
        rows = [find(t or "") for t in cols["text"]]
        out: dict[str, list] = {"doc_id": cols["doc_id"]}
        for k in base:
            out[f"n_{RULES[k].kind}"] = [sum(x[1] == k for x in r) for r in rows]
        out["base_sha256"] = [hashlib.sha256(joined([x for x in r if RULES[x[1]].base]).encode()).hexdigest() for r in rows]
        out["spans"] = list(map(joined, rows))
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced by marks and ``n_col`` kept in step.

    Null text stays null. All rows and all other columns stay as they are.
    """
    schema = docs.schema
    names = docs.columns

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [t if t is None else redact(t) for t in cols[text_col]]
        if n_col in names:
            cols[n_col] = [n if new == old else len(new) for n, new, old in zip(cols[n_col], texts, cols[text_col], strict=True)]
        cols[text_col] = texts
        return cols

    return common.map_batches(docs, run, schema)
