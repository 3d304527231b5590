"""Graph construction: upserts as aggregations and joins, claim linking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.runtime import shuffled


def upsert_entities(existing: DataFrame | None, found: DataFrame) -> DataFrame:
    """Entities by (name, type): mentions add up, confidence is the largest, the first description stays.

    ``found``: name, type, description, confidence, seq. ``existing``: id, name,
    type, description, confidence, mention_count. Keys are case-sensitive; ids are not.
    """
    new = found.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"), F.min_by("description", "seq").alias("d"))
    if existing is None:
        return new.select(T.entity_id(F.col("name"), F.col("type")).alias("id"), "name", "type", F.col("d").alias("description"), F.col("c").alias("confidence"), F.col("n").alias("mention_count"))
    both = existing.join(new, ["name", "type"], "full_outer")
    return both.select(
        F.coalesce("id", T.entity_id(F.col("name"), F.col("type"))).alias("id"),
        "name",
        "type",
        F.when(F.col("id").isNotNull(), F.col("description")).otherwise(F.col("d")).alias("description"),
        F.greatest("confidence", "c").alias("confidence"),
        (F.when(F.col("id").isNotNull(), F.coalesce("mention_count", F.lit(1))).otherwise(0) + F.coalesce("n", F.lit(0))).alias("mention_count"),
    )


def upsert_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.dropDuplicates(["text_unit_id", "entity_id"])


def resolve_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationship ends from names to the least id of that name."""
    ids = entities.groupBy("name").agg(F.min("id").alias("id"))
    src = ids.withColumnsRenamed({"name": "source", "id": "src"})
    dst = ids.withColumnsRenamed({"name": "target", "id": "dst"})
    return relations.join(src, "source").join(dst, "target")


def upsert_relationships(relations: DataFrame) -> DataFrame:
    """Edges by (src, rel_label, dst): largest confidence, first description by ``seq``."""
    return relations.groupBy("src", "rel_label", "dst").agg(F.max("confidence").alias("confidence"), F.min_by("description", "seq").alias("description"), F.count(F.lit(1)).alias("weight"))


def rel_key(kind: Column, description: Column, label: Column) -> Column:
    return F.coalesce(kind, description, label)


def upsert_claims(claims: DataFrame) -> DataFrame:
    """Claims by id: occurrences counted, the first values by ``seq`` stay."""
    keyed = claims.withColumn("claim_id", T.claim_id(*(F.col(c) for c in ("subject", "object", "claim_type", "description", "source_text"))))
    first = [F.min_by(c, "seq").alias(c) for c in ("subject", "object", "claim_type", "status", "start_date", "end_date", "description", "source_text")]
    return keyed.groupBy("claim_id").agg(*first, F.count(F.lit(1)).alias("occurrence_count"))


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containments(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """``needle, hay`` for every non-empty needle inside a text of ``hay`` (columns of these names, distinct).

    A needle of three characters or more meets the texts by the rarest of its
    trigrams, which any text around it has; a shorter one by itself. The meeting
    is an equi-join and is then verified. Texts are cut into pieces of one and
    two characters only if a needle is that short.
    """
    short = not needles.where("length(needle) between 1 and 2").isEmpty()
    grams = hay.select("hay", F.explode(F.concat(*(_grams(F.col("hay"), n) for n in ((1, 2, 3) if short else (3,))))).alias("gram"))
    seen = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    own = needles.where("needle <> ''").select("needle", F.explode(F.when(F.length("needle") < 3, F.array("needle")).otherwise(_grams(F.col("needle"), 3))).alias("gram"))
    rarest = own.join(seen, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))["gram"].alias("gram"))
    return rarest.join(shuffled(grams), "gram").where(F.contains("hay", "needle")).select("needle", "hay")


def link_names(claims: DataFrame, entities: DataFrame, name_col: str) -> DataFrame:
    """Best entity for each claim's ``name_col``: ``claim_id, entity_id, strategy``.

    1 equal; 2 equal ignoring case; 3 one without parenthesised parts is the
    other's prefix or equal; 4 the wanted name without parenthesised parts and an
    entity's name without parenthesis characters, one inside the other, also
    inside a word. The lowest strategy wins, then the shortest name, then the
    least id. Steps 1 and 2 are equi-joins. Steps 3 and 4 run only for distinct
    names without a match so far, on the candidates of ``containments``; a name
    of which nothing is left takes no part in them.
    """
    names = claims.select(F.col(name_col).alias("wanted")).where("wanted is not null and trim(wanted) <> ''").distinct()
    named = entities.groupBy("name").agg(F.min("id").alias("entity_id"))
    exact = names.join(named, names.wanted == named.name).select("wanted", "entity_id", "name", F.lit(1).alias("strategy"))
    folded = names.join(named, F.lower("wanted") == F.lower("name")).select("wanted", "entity_id", "name", F.lit(2).alias("strategy"))
    rest = names.join(folded.select("wanted").distinct(), "wanted", "left_anti").select("wanted", F.lower(T.strip_parens(F.col("wanted"))).alias("w"))
    both = [exact, folded]
    for strategy, cleaned in ((3, T.strip_parens(F.col("name"))), (4, T.drop_paren_chars(F.col("name")))):
        other = named.select("name", "entity_id", F.lower(cleaned).alias("c"))
        w, c = rest.select("w").distinct(), other.select("c").distinct()
        inside = containments(w.select(F.col("w").alias("needle")), c.select(F.col("c").alias("hay"))).select(F.col("needle").alias("w"), F.col("hay").alias("c"))
        around = containments(c.select(F.col("c").alias("needle")), w.select(F.col("w").alias("hay"))).select(F.col("hay").alias("w"), F.col("needle").alias("c"))
        met = inside.unionByName(around).distinct()
        if strategy == 3:
            met = met.where(F.startswith("w", "c") | F.startswith("c", "w"))
        both.append(rest.join(met, "w").join(other, "c").select("wanted", "entity_id", "name", F.lit(strategy).alias("strategy")))
    order = Window.partitionBy("wanted").orderBy("strategy", F.length("name"), "entity_id")
    best = reduce(DataFrame.unionByName, both).withColumn("n", F.row_number().over(order)).where("n = 1")
    return claims.select("claim_id", F.col(name_col).alias("wanted")).join(best, "wanted").select("claim_id", "entity_id", "strategy")


def link_sources(claims: DataFrame, text_units: DataFrame) -> DataFrame:
    """Distinct (claim_id, text_unit_id) of claims whose text unit exists."""
    return claims.select("claim_id", "text_unit_id").join(text_units.select(F.col("id").alias("text_unit_id")), "text_unit_id", "left_semi").distinct()


def update_entities(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial updates by id: given values replace, null keeps, confidence never falls."""
    c = changes.select("id", F.col("description").alias("d"), F.col("confidence").alias("c"))
    return entities.join(c, "id", "left").withColumns({"description": F.coalesce("d", "description"), "confidence": F.greatest("confidence", "c")}).drop("d", "c")


def set_values(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``changes`` where it has the key."""
    return rows.join(changes.select(key, F.col(column).alias("changed")), key, "left").withColumn(column, F.coalesce("changed", column)).drop("changed")


def insert_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def upsert_rows(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``existing`` that it does not replace."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values of more than one row: the violations of a uniqueness rule."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
