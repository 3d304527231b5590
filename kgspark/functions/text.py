"""Scalar text expressions: Columns in, Columns out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters to remove (fixed values); the second set also drops DEL and C1.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CONTROLS_WIDE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def count_tokens(text: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def split_paragraphs(text: Column) -> Column:
    """Trimmed, non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(F.trim(text), r"\n\n+"), lambda p: F.trim(p)), lambda p: p != "")


def split_sentences(text: Column) -> Column:
    """Non-empty parts after ``. ! ?`` followed by white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def entity_id(name: Column, kind: Column) -> Column:
    """16 hex digits from the trimmed lower-case name and lower-case type."""
    return F.substring(F.md5(F.concat_ws(":", F.lower(F.trim(name)), F.lower(kind))), 1, 16)


def claim_id(subject: Column, object_: Column, kind: Column, description: Column, source: Column) -> Column:
    """16 hex digits from the claim's parts; null counts as the empty text."""
    parts = [F.coalesce(c, F.lit("")) for c in (subject, object_, kind, description, source)]
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16)


def strip_parens(name: Column) -> Column:
    """The name without parenthesised parts and the space around them."""
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*", ""))


def drop_paren_chars(name: Column) -> Column:
    return F.translate(name, "()", "")


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def take(values: Column, n: int) -> Column:
    """First ``n`` elements."""
    return F.slice(values, 1, n)


def append_unique(values: Column, value: Column) -> Column:
    """The array with ``value`` at its end unless it holds it; a null array counts as empty."""
    held = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(F.array_contains(held, value), held).otherwise(F.array_append(held, value))


def scrub(text: Column, wide: bool = False) -> Column:
    return F.regexp_replace(text, CONTROLS_WIDE if wide else CONTROLS, "")


def strip_fence(text: Column) -> Column:
    """The inside of the first code fence; the trimmed text if there is none."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    return F.when(inside != "", inside).otherwise(F.trim(text))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def scaled_strength(strength: Column) -> Column:
    """Strength out of ten as a confidence in [0, 1]; 5 if it is no number."""
    return F.least(F.greatest(F.coalesce(strength.try_cast("double"), F.lit(5.0)) / 10, F.lit(0.0)), F.lit(1.0))


def join_themes(themes: Column) -> Column:
    return F.concat_ws(",", themes)


def split_themes(themes: Column) -> Column:
    return F.split(themes, ",")


def rank_tokens(text: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def question_words(text: Column) -> Column:
    """Lower-case words of three characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), 1), lambda w: F.length(w) > 2)
