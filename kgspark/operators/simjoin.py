"""Similarity join of names: pairs of one type that can reach a threshold, without meeting all pairs.

A ratio of ``t`` between names of ``x`` and ``y`` characters needs ``M`` of them
matched in order. Three ways share the pairs, by how common the bigrams are:

* names meet by their rarest bigrams (as many as a pair at the threshold cannot all
  avoid). A pair is made once, at the first bigram that both share, and only if
  that bigram's places in both and both lengths leave room for the overlap needed;
* a bigram that more than ``hot`` names of a type hold is no such key: names of one
  pattern share it without being alike. Names with one meet by what is left of
  them when letters go: a pair with ``M`` letters in order has the same remains of
  ``M`` letters, so those that meet are those that are near;
* pairs of names too long for that (more than ``most_variants`` remains) meet at
  the hot bigram itself in blocks, by classes of length.

Every pair made is held against a bound on its edit distance at once. The pairs are
complete and, where the metric is not the edit distance, still to be verified by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.runtime import discard, materialize, shuffled, spread

EPS = 1e-9
#: Names of a block at a hot bigram.
BLOCK = 256
#: Lengths of one class differ by less than this factor.
CLASS = 1.15


def matched(x: int, y: int, threshold: float, edits: bool) -> int:
    """Characters that names of these lengths share in order at the threshold, at least."""
    if edits:
        return max(x, y) - math.floor((1 - threshold) * max(x, y) + EPS)
    return math.ceil(threshold * (x + y) / 2 - EPS)


def matched_column(x: Column, y: Column, threshold: float, edits: bool) -> Column:
    if edits:
        longest = F.greatest(x, y)
        return longest - F.floor((1 - F.lit(threshold)) * longest + EPS)
    return F.ceil(F.lit(threshold) * (x + y) / 2 - EPS)


@lru_cache(maxsize=64)
def _limits(most_variants: int) -> list[int]:
    """At place ``d - 1``: the longest name of which ``d`` letters can go in at most ``most_variants`` ways."""
    out = []
    for d in range(1, 13):
        x = d
        while x < most_variants and math.comb(x + 1, min(d, (x + 1) // 2)) <= most_variants:
            x += 1
        out.append(x)
    return out


def reachable(a: Column, b: Column, threshold: float, edits: bool) -> Column:
    """In the JVM: no pair of normalised names that fails this passes the metric.

    With M characters matched in order, x + y - 2M go or come, so the edit
    distance is at most that.
    """
    x, y = F.length(a), F.length(b)
    m = matched_column(x, y, threshold, edits)
    most = F.greatest(x, y) - m if edits else x + y - 2 * m
    return (m <= F.least(x, y)) & (F.levenshtein(a, b) <= most)


def most_gone(x: int, most_variants: int) -> int:
    return min(x, sum(x <= limit for limit in _limits(most_variants)))


def most_gone_column(x: Column, most_variants: int) -> Column:
    out = F.lit(0)
    for limit in _limits(most_variants):
        out = out + F.when(x <= limit, 1).otherwise(0)
    return F.least(x, out)


def partners(x: int, threshold: float, edits: bool) -> Iterator[tuple[int, int]]:
    """Lengths that a name of ``x`` characters can be alike with, and the match needed."""
    t = threshold
    low, high = (t * x, x / t) if edits else (x * t / (2 - t), x * (2 - t) / t)
    for y in range(max(1, math.floor(low) - 1), math.ceil(high) + 2):
        if (m := matched(x, y, t, edits)) <= min(x, y):
            yield y, m


@lru_cache(maxsize=4096)
def _plan(x: int, threshold: float, edits: bool, most_variants: int, lengths: frozenset[int]) -> tuple[list[int], list[int]]:
    """Numbers of letters that go, and classes of lengths with which that does not do, for partners of these ``lengths``."""
    gone, blocked = set(), set()
    for y, m in partners(x, threshold, edits):
        if y not in lengths:
            continue
        if x - m <= most_gone(x, most_variants) and y - m <= most_gone(y, most_variants):
            gone |= set(range(x - m + 1)) if edits else {x - m}
        else:
            blocked.add(length_class(y))
    return sorted(gone), sorted(blocked)


def length_class(x: int) -> int:
    return math.floor(math.log(x) / math.log(CLASS))


def remains(name: str, gone: list[int], edits: bool) -> Iterator[tuple[str, int, list[int]]]:
    """What is left of a name when letters go: text, how many went, and (for edits) between which letters.

    Without edits only the text counts, and each comes once, however many equal letters could go.
    """
    for d in gone:
        seen = set()
        for places in combinations(range(len(name)), d):
            left, at, gaps = [], 0, []
            for i, p in enumerate(places):
                left.append(name[at:p])
                at = p + 1
                if edits:
                    gap = p - i
                    gaps.append(gap * 16 + sum(q - j == gap for j, q in enumerate(places[:i])))
            text = "".join([*left, name[at:]])
            if edits or text not in seen:
                if not edits:
                    seen.add(text)
                yield text, d, gaps


def _numbered(items: str) -> Column:
    """A sorted array column with the count of equal items so far, so that a multiset is a set."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit(":"), (i - F.array_position(F.col(items), x) + 1).cast("string")))


def _sides() -> Column:
    """One name is of the left side, the other of the right."""
    left, right = (lambda s: F.col(f"{s}.side").bitwiseAND(1) > 0), (lambda s: F.col(f"{s}.side").bitwiseAND(2) > 0)
    return (left("a") & right("b")) | (right("a") & left("b"))


def _keyed(names: DataFrame, items: Column, need: Column, hot: int, tag: str) -> DataFrame:
    """Names with the keys by which they meet, rarest first: ``cold`` ones, then ``hot`` ones with their counts."""
    # a column of its own: inside the lambda an expression would be computed once an item
    marked = names.select("type", "n", "side", F.length("n").alias("x"), need.alias("need"), F.sort_array(items).alias("held"))
    single = materialize(marked.select("type", "n", "side", "x", "need", F.size("held").alias("size"), F.explode(_numbered("held")).alias("text")).select("type", "n", "side", "x", "need", "size", F.xxhash64("text").alias("item")), tag)
    counts = single.groupBy("type", "item").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("type", "n").orderBy("df", "item")
    keys = shuffled(single).join(counts, ["type", "item"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("size") - F.greatest("need", F.lit(1)) + 1)
    listed = keys.groupBy("type", "n").agg(F.first("side").alias("side"), F.first("x").alias("x"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", "item", "df"))).alias("keys"))
    cold = F.filter("keys", lambda k: k["df"] <= hot)
    warm = F.filter("keys", lambda k: k["df"] > hot)
    out = materialize(listed.select("type", "n", "side", "x", "size", F.transform(cold, lambda k: k["item"]).alias("cold"), warm.alias("hot")), tag)
    discard(single)
    return out


def _meet(a: DataFrame, b: DataFrame, on: list[str], *more: Column) -> DataFrame:
    condition = F.col("a.n") < F.col("b.n")
    for c in on:
        condition = condition & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    for c in (_sides(), *more):
        condition = condition & c
    return shuffled(a.alias("a")).join(shuffled(b.alias("b")), condition).select(F.col("a.type").alias("type"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"))


def _meeting(names: DataFrame, items: Column, need: Column, threshold: float, edits: bool, hot: int, most_variants: int, letters: bool = False) -> list[DataFrame]:
    """The pairs of each way."""
    x, y = F.col("a.x"), F.col("b.x")
    m = matched_column(x, y, threshold, edits)
    lengths = m <= F.least(x, y)
    near = reachable(F.col("a.n"), F.col("b.n"), threshold, edits)
    shared = m if letters else 3 * m - x - y - 1
    room = 1 + F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) >= shared
    keyed = _keyed(names, items, need, hot, "names-keyed")
    one = keyed.select("type", "n", "side", "x", "size", "cold", F.posexplode("cold").alias("at", "item")).withColumn("place", F.col("at") + 1)
    first_cold = F.element_at(F.array_intersect("a.cold", "b.cold"), 1) == F.col("a.item")
    one = spread(one, "type", "item")
    out = [_meet(one, one, ["type", "item"], lengths, room, near, first_cold)]

    patterned = keyed.where(F.size("hot") > 0)
    sides = patterned.select("side", "x").distinct().collect()  # at most three rows a length
    other = {s: frozenset(r["x"] for r in sides if (s & 1 and r["side"] & 2) or (s & 2 and r["side"] & 1)) for s in (1, 2, 3)}
    planned = [_plan(r["x"], threshold, edits, most_variants, other[r["side"]]) for r in sides]
    if any(gone for gone, _ in planned):
        # a pair meets once for each text that both leave
        out.append(_by_remains(patterned, threshold, edits, most_variants, other, lengths, near).distinct())
    if any(blocked for _, blocked in planned):
        out.append(_by_blocks(patterned, threshold, edits, most_variants, other, lengths, room, near))
    return out


def _by_remains(patterned: DataFrame, threshold: float, edits: bool, most_variants: int, other: dict[int, frozenset[int]], lengths: Column, near: Column) -> DataFrame:
    """Pairs that meet by what is left of them when letters go."""
    x, y = F.col("a.x"), F.col("b.x")
    schema = "type string, n string, side int, x int, left string, gone int, gaps array<int>"
    t, most = threshold, most_variants

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("type", "n", "side", "x", "left", "gone", "gaps")}
            for row in batch.to_pylist():
                for text, d, gaps in remains(row["n"], _plan(row["x"], t, edits, most, other[row["side"]])[0], edits):
                    for k, v in zip(out, (row["type"], row["n"], row["side"], row["x"], text, d, gaps), strict=True):
                        out[k].append(v)
                if len(out["n"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
                    out = {k: [] for k in out}
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = pa.schema([("type", pa.string()), ("n", pa.string()), ("side", pa.int32()), ("x", pa.int32()), ("left", pa.string()), ("gone", pa.int32()), ("gaps", pa.list_(pa.int32()))])
    left = spread(patterned.select("type", "n", "side", "x"), "n").mapInArrow(run, schema).withColumn("key", F.xxhash64("type", "left")).drop("left")
    if edits:
        budget = F.floor((1 - F.lit(threshold)) * F.greatest(x, y) + EPS)
        close = F.col("a.gone") + F.col("b.gone") - F.size(F.array_intersect("a.gaps", "b.gaps")) <= budget
    else:
        left = left.drop("gaps")
        m = matched_column(x, y, threshold, edits)
        close = (x - F.col("a.gone") == m) & (y - F.col("b.gone") == m)
    left = spread(left, "key", "type")
    return _meet(left, left, ["key", "type"], lengths, close, near)


def _by_blocks(patterned: DataFrame, threshold: float, edits: bool, most_variants: int, other: dict[int, frozenset[int]], lengths: Column, room: Column, near: Column) -> DataFrame:
    """Pairs too long for that, at their first hot bigram in blocks."""
    x, y = F.col("a.x"), F.col("b.x")
    m = matched_column(x, y, threshold, edits)
    own = [f.name for f in patterned.schema.fields]
    t, most = threshold, most_variants
    classes = F.pandas_udf(lambda v, w: pd.Series([_plan(int(k), t, edits, most, other[int(s)])[1] for k, s in zip(v, w, strict=True)]), "array<int>")
    wide = patterned.withColumn("classes", classes("x", "side")).where(F.size("classes") > 0).withColumn("class", F.floor(F.log("x") / math.log(CLASS) + F.lit(0.0)).cast("int"))
    blocks = wide.select(*own, "classes", "class", F.explode("hot").alias("k")).select("*", F.col("k.item").alias("item"), F.col("k.place").alias("place"), F.ceil(F.col("k.df") / BLOCK).cast("int").alias("blocks"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("near_class", F.explode("classes")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumns({"c1": F.least("class", "near_class"), "c2": F.greatest("class", "near_class"), "b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
    blocks = spread(blocks, "type", "item", "c1", "c2", "b1", "b2")
    both = (F.col("a.near_class") == F.col("b.class")) & (F.col("b.near_class") == F.col("a.class")) & ((F.col("a.block") == F.col("b.other")) & (F.col("b.block") == F.col("a.other")))
    far = (x - m > most_gone_column(x, most_variants)) | (y - m > most_gone_column(y, most_variants))
    items_of = lambda s: F.transform(F.col(f"{s}.hot"), lambda k: k["item"])
    first_hot = (F.element_at(F.array_intersect(items_of("a"), items_of("b")), 1) == F.col("a.item")) & ~F.arrays_overlap("a.cold", "b.cold")
    return _meet(blocks, blocks, ["type", "item", "c1", "c2", "b1", "b2"], both, lengths, far, room, near, first_hot)


def name_pairs(names: DataFrame, threshold: float, edits: bool = False, written: bool = False, hot: int = 256, most_variants: int = 1000) -> DataFrame:
    """``type, n1, n2`` (n1 < n2): all pairs of distinct names (``type, n, side``) that can reach ``threshold``.

    ``side``: 1 left, 2 right, 3 both; a pair has one name of either side.
    ``edits``: the ratio is 1 - edit distance / longer length, else it is that of
    matched characters (2 M / sum of lengths).
    ``written``: every way is a query of its own, since adaptive execution plans
    what is left of a query anew after every stage.

    Each of the x - M characters that go breaks at most two bigrams of the first
    name, each of the y - M that come breaks at most one, so 3M - x - y - 1 are
    shared. Names too short for one sure bigram meet by their letters as well.
    """
    x = F.length("n")
    need = F.ceil((1.5 * threshold - 1) * 2 * x / (2 - threshold) - 1 - EPS)
    bigrams = F.when(x >= 2, F.transform(F.sequence(F.lit(1), F.greatest(x - 1, F.lit(1))), lambda i: F.substr(F.col("n"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    letters = F.filter(F.split("n", ""), lambda c: c != "")
    ways = _meeting(names.where(x >= 2), bigrams, need, threshold, edits, hot, most_variants)
    short = names.where((need <= 0) & (x >= 1))
    if not short.isEmpty():
        ways += _meeting(short, letters, F.ceil(x * threshold / (2 - threshold) - EPS), threshold, edits, hot, most_variants, letters=True)
    if not written:
        return reduce(DataFrame.unionByName, ways).distinct()
    ways = [materialize(way, "names-way") for way in ways]
    met = materialize(reduce(DataFrame.unionByName, ways).distinct(), "names-met")
    discard(*ways)
    return met
