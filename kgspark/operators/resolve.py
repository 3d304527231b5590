"""Entity resolution: similarity joins, decisions and set-based merging."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.runtime import materialize, shuffled, spread

from . import blockjoin, simjoin
from .components import connected_components


def ratio(a: str | None, b: str | None) -> float | None:
    """1 for names equal after trimming and lower-casing, else the sequence matcher's ratio; it depends on the order."""
    if a is None or b is None:
        return None
    x, y = a.lower().strip(), b.lower().strip()
    return 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Another metric, in the JVM: 1 - edit distance / longer length."""
    x, y = normal(a), normal(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


#: White space as the metric trims it, in Java's notation (fixed values).
BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def normal(name: Column) -> Column:
    """A name as the metric compares it: lower case, without white space at either end."""
    return F.regexp_replace(F.lower(name), rf"\A{BLANKS}|{BLANKS}\z", "")


def possible(a: Column, b: Column, threshold: float) -> Column:
    """No pair that fails this reaches the threshold: ratio <= 2 min(length) / sum of lengths."""
    x, y = F.length(normal(a)), F.length(normal(b))
    return 2 * F.least(x, y) >= threshold * (x + y) - 1e-9


def is_edits(metric) -> bool:  # noqa: ANN001
    return metric is levenshtein_ratio


#: Names of a type up to which all its pairs are compared in blocks.
MOST_BLOCKED = 1 << 20


def duplicate_pairs(entities: DataFrame, threshold: float = 0.85, metric=sequence_ratio) -> DataFrame:  # noqa: ANN001
    """Pairs of one type at or above ``threshold``: ``id1, name1, id2, name2, type, similarity``.

    The pair's order is that of (type, name, id). Null names and types pair with
    nothing; names that are equal once normalised, empty ones too, always pair.
    Names of a type are held against each other in blocks (``blockjoin``). Types
    of more than ``MOST_BLOCKED`` names, names of more letters than a machine word
    has bits and other metrics go by ``simjoin.name_pairs``; neither loses a pair.
    """
    named = materialize(entities.where("name is not null and type is not null").select("id", "name", "type", normal(F.col("name")).alias("n")), "names-all")
    if metric not in (sequence_ratio, levenshtein_ratio):
        return _pairs_by_ways(named, named.select("type", "n").distinct().withColumn("side", F.lit(3)), threshold, metric)
    names = materialize(named.select("type", "n").distinct(), "names")
    is_long = F.length("n") > blockjoin.LONGEST
    # one row a type: names of such a type, or its long ones with all others, take the other ways
    kinds = names.groupBy("type").agg((F.count(F.lit(1)) > MOST_BLOCKED).alias("large"), F.max(is_long).alias("long")).where("large or long")
    kinds = materialize(kinds, "names-types")
    if kinds.isEmpty():
        return blockjoin.alike_pairs(named, threshold, is_edits(metric), ratio)
    sides = names.join(shuffled(kinds), "type").select("type", "n", F.when(F.col("large") | is_long, 3).otherwise(2).alias("side"))
    by_ways = _pairs_by_ways(named, sides, threshold, metric)
    short = named.where(~is_long).join(shuffled(kinds.where("large").select("type")), "type", "left_anti").select("id", "name", "type", "n")
    return by_ways.unionByName(blockjoin.alike_pairs(short, threshold, is_edits(metric), ratio))


def _pairs_by_ways(named: DataFrame, names: DataFrame, threshold: float, metric) -> DataFrame:  # noqa: ANN001
    """Pairs with one name of side 1 (bit) at least, sought among the distinct normalised names (``type, n, side``); the metric runs once for each pair of spellings."""
    names = materialize(names, "names")
    met = simjoin.name_pairs(names, threshold, is_edits(metric), True)
    same = names.where("side = 3").select("type", F.col("n").alias("n1"), F.col("n").alias("n2"))
    met = met.unionByName(same)
    spelled = named.select("type", "n", "name").distinct()
    one, two = spelled.select("type", F.col("n").alias("n1"), F.col("name").alias("u")), spelled.select("type", F.col("n").alias("n2"), F.col("name").alias("v"))
    pairs = shuffled(met).join(one, ["type", "n1"]).join(two, ["type", "n2"])
    pairs = spread(pairs.select("type", F.least("u", "v").alias("name1"), F.greatest("u", "v").alias("name2")), "type", "name1", "name2").distinct()
    pairs = pairs.withColumn("similarity", metric(F.col("name1"), F.col("name2"))).where(F.col("similarity") >= threshold)
    ids = named.select("type", "name", "id")
    out = pairs.join(ids.withColumnsRenamed({"name": "name1", "id": "id1"}), ["type", "name1"]).join(ids.withColumnsRenamed({"name": "name2", "id": "id2"}), ["type", "name2"])
    return out.where((F.col("name1") < F.col("name2")) | (F.col("id1") < F.col("id2"))).select("id1", "name1", "id2", "name2", "type", "similarity")


def similar_entities(entities: DataFrame, name: str, kind: str, threshold: float = 0.85, metric=sequence_ratio) -> DataFrame:  # noqa: ANN001
    """Entities of one type with threshold <= similarity < 1 to ``name``, best first, rounded to 3 places."""
    near = entities.where((F.col("type") == kind) & simjoin.reachable(normal(F.lit(name)), normal(F.col("name")), threshold, is_edits(metric)))
    scored = near.withColumn("similarity", metric(F.lit(name), F.col("name"))).where((F.col("similarity") >= threshold) & (F.col("similarity") < 1))
    return scored.withColumn("similarity", F.round("similarity", 3)).orderBy(F.desc("similarity"), "id")


def similar_to_all(entities: DataFrame, wanted: DataFrame, threshold: float = 0.85, metric=sequence_ratio, by_type: bool = True) -> DataFrame:  # noqa: ANN001
    """``key, id, similarity`` of all entities at or above ``threshold`` to the names of a table ``key, name`` (with ``type`` if ``by_type``).

    One similarity join of both tables' distinct names; null names and types meet nothing.
    """
    kind = F.col("type") if by_type else F.lit("")
    left = wanted.select("key", "name", kind.alias("type"), normal(F.col("name")).alias("n")).where("name is not null and type is not null")
    right = entities.select("id", "name", kind.alias("type"), normal(F.col("name")).alias("n")).where("name is not null and type is not null")
    sides = left.select("type", "n", F.lit(1).alias("side")).unionByName(right.select("type", "n", F.lit(2).alias("side")))
    names = materialize(sides.groupBy("type", "n").agg(F.bit_or("side").alias("side")), "names")
    met = simjoin.name_pairs(names, threshold, is_edits(metric), True)
    ways = shuffled(met.union(met.select("type", "n2", "n1")).union(names.where("side = 3").select("type", F.col("n").alias("n1"), F.col("n").alias("n2"))))
    spelled = ways.join(left.select("type", F.col("n").alias("n1"), F.col("name").alias("u")).distinct(), ["type", "n1"]).join(right.select("type", F.col("n").alias("n2"), F.col("name").alias("v")).distinct(), ["type", "n2"])
    scored = spread(spelled.select("type", "u", "v"), "type", "u", "v").select("type", "u", "v", metric(F.col("u"), F.col("v")).alias("similarity")).where(F.col("similarity") >= threshold)
    out = scored.join(left.select("key", "type", F.col("name").alias("u")), ["type", "u"]).join(right.select("id", "type", F.col("name").alias("v")), ["type", "v"])
    return out.select("key", "id", "similarity")


#: Bars that a search for the best names tries before its own: near names are few and cheap to find.
BARS = (0.9, 0.85, 0.75)


def bars(above: float) -> list[float]:
    """Falling bars down to ``above``: what has enough names at one needs no lower one, since all others are below it."""
    return [*(b for b in BARS if b > above), above]


def best_matches(entities: DataFrame, wanted: DataFrame, above: float = 0.8, metric=sequence_ratio) -> DataFrame:  # noqa: ANN001
    """``key, id, similarity``: for each name of a table ``key, name`` the most similar entity of any type, strictly above the bar; first by id on ties."""
    first = F.min(F.struct((-F.col("similarity")).alias("less"), "id")).alias("best")
    named = materialize(entities.select("id", "name"), "names-all")
    left, out = materialize(wanted, "names-left"), None
    for bar in bars(above):
        found = similar_to_all(named, left, bar, metric, by_type=False).where(F.col("similarity") > above)
        best = materialize(found.groupBy("key").agg(first), "names-best")
        out = best if out is None else out.unionByName(best)
        if bar == above:
            break
        left = materialize(left.join(best.select("key"), "key", "left_anti"), "names-left")
        if left.isEmpty():
            break
    best = out.groupBy("key").agg(F.min("best").alias("best"))
    return best.select("key", "best.id", (-F.col("best.less")).alias("similarity"))


def decide(pairs: DataFrame) -> DataFrame:
    """``decision`` merge (>= 0.95), ask (>= 0.85) or keep; ``primary_id`` has more mentions, the first on ties."""
    first = F.col("mentions1") >= F.col("mentions2")
    return pairs.withColumns(
        {
            "decision": F.when(F.col("similarity") >= 0.95, "merge").when(F.col("similarity") >= 0.85, "ask").otherwise("keep"),
            "primary_id": F.when(first, F.col("id1")).otherwise(F.col("id2")),
            "duplicate_id": F.when(first, F.col("id2")).otherwise(F.col("id1")),
        }
    )


def merge_map(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """``id, primary_id`` of every merged entity: chains of accepted pairs are one group, whose primary has most mentions, then the least (type, name, id)."""
    groups = connected_components(pairs, "id1", "id2").withColumnRenamed("node", "id")
    members = groups.join(entities.select("id", "name", "type", "mention_count"), "id")
    best = members.groupBy("component").agg(F.min(F.struct((-F.coalesce("mention_count", F.lit(1))).alias("m"), "type", "name", "id"))["id"].alias("primary_id"))
    return members.join(best, "component").select("id", "primary_id")


def merge_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities after the merge: mentions add up, names of the duplicates become aliases."""
    own = entities.join(mapping, "id", "left").withColumn("primary_id", F.coalesce("primary_id", "id"))
    is_primary = F.col("id") == F.col("primary_id")
    keep = lambda c: F.max(F.when(is_primary, F.col(c))).alias(c)
    names = F.flatten(F.collect_list(F.concat(F.when(is_primary, F.array().cast("array<string>")).otherwise(F.array("name")), F.coalesce("aliases", F.array().cast("array<string>")))))
    merged = own.groupBy(F.col("primary_id").alias("id")).agg(keep("name"), keep("type"), keep("description"), F.max("confidence").alias("confidence"), F.sum(F.coalesce("mention_count", F.lit(1))).alias("mention_count"), names.alias("aliases"))
    return merged.withColumn("aliases", F.array_sort(F.array_distinct(F.array_remove("aliases", F.col("name")))))


def merge_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges moved to the primaries: loops go, parallel edges keep the largest confidence."""
    m = mapping.where("id <> primary_id")
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(m.select(F.col("id").alias(end), F.col("primary_id").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return moved.where("src <> dst").groupBy("src", "rel_label", "dst").agg(F.max("confidence").alias("confidence"))


def merge_mentions(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("id").alias("entity_id"), "primary_id")
    return mentions.join(m, "entity_id", "left").select("text_unit_id", F.coalesce("primary_id", "entity_id").alias("entity_id")).distinct()


def rename_conflicts(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Requested new names (id, name) and whether another entity of the type has that name."""
    wanted = names.select("id", F.col("name").alias("new_name")).join(entities.select("id", "type"), "id")
    taken = entities.select(F.col("id").alias("other"), F.col("name").alias("new_name"), "type")
    hit = wanted.join(taken, ["new_name", "type"]).where("id <> other").select("id").distinct().withColumn("conflict", F.lit(True))
    return wanted.join(hit, "id", "left").select("id", "new_name", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def best_match(entities: DataFrame, name: str, above: float = 0.8, metric=sequence_ratio) -> DataFrame:  # noqa: ANN001
    """The entity most similar to ``name``, strictly above the bar; first by id on ties."""
    near = entities.where(simjoin.reachable(normal(F.lit(name)), normal(F.col("name")), above, is_edits(metric)))
    scored = near.withColumn("similarity", metric(F.lit(name), F.col("name")))
    return scored.where(F.col("similarity") > above).orderBy(F.desc("similarity"), "id").limit(1)


def question_entities(entities: DataFrame, question: str, n: int = 3, above: float = 0.6) -> DataFrame:
    """Up to ``n`` entities for a question: 1 if the name is in it, else the best ratio with one of its words."""
    words = [w for w in pd.Series([question.lower()]).str.findall(r"\w+")[0] if len(w) > 2]
    inside = F.contains(F.lit(question.lower()), F.lower("name"))
    score = F.when(inside, F.lit(1.0))
    if words:
        score = score.otherwise(F.greatest(*(sequence_ratio(F.lit(w), F.col("name")) for w in words), F.lit(0.0)))
    near = inside
    for w in words:  # the metric only sees names that may pass
        near = near | possible(F.lit(w), F.col("name"), above)
    return entities.where(near).withColumn("score", F.coalesce(score, F.lit(0.0))).where(F.col("score") > above).orderBy(F.desc("score"), "id").limit(n)
