"""Source divergence audit: how far the word use of each source lies from every other source of its language.

Every group (language, source) and every language gives every kept term of the
language a scaled, smoothed probability ``p``; a pair of groups is as far apart as
the sum over all kept terms of ``f(p, q) = floor((p - q)^2 / (p + q))``. Almost all
of these terms are zero in one or both groups, so the sum is taken by inclusion
and exclusion over the supports A and B of the two groups:

* terms of A, as if B had none of them, and the reverse: priced from the histogram
  of a group's probabilities, one price a distinct value and other group;
* terms of both: a join of the postings (language, term) corrects the two prices;
* terms of neither: one constant price, times ``V - |A| - |B| + |A and B|``.

Only rows of terms that occur are made; no table of groups x terms exists. Counts
are summed in the workers before they are shuffled, the join has at most one row a
source and term on either side, and the histograms meet the groups under a salt,
as there are few languages. All arithmetic is exact (longs; decimals for ``p``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.runtime import discard, materialize

from .common import relax
from .words import TERMS, binary, pieces, utf8

#: A term is kept in a language if so many of its documents hold it.
LEAST_DOCS = 10
#: Terms reported of a group.
TOP_TERMS = 10
#: Distinct terms held in a worker before they are sent on.
HELD = 300_000
#: Blocks in which the histograms of a language meet its groups.
BLOCKS = 32


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), summed within a task up to ``HELD`` entries."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    names = ["lang", "source", "term", "n", "docs"]

    def sums(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_of) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                counts = [pa.array([c[t] for t in part], type=pa.int64()) for c in (n, docs_of)]
                fixed = [pa.array([v] * len(part), type=pa.string()) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*fixed, utf8(part), *counts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for text, lang, source in zip(binary(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in pieces(text, TERMS):
                    n.update(words)
                    seen.update(words)
                docs_of.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield from sums(held)
                    held.clear()
                    size = 0
        yield from sums(held)
        held.clear()
        relax()

    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)); null where there is no term."""
    above = f"cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))"
    return F.expr(f"1 + ({above}) div cast(nullif({total} + 2 * {terms}, 0) as decimal(20,0))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so all of it fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """Rows (lang, source, term, n) of the terms that a language keeps, with the language's ``total`` and a mark at one row a term."""
    w = Window.partitionBy("lang", "term")
    counts = term_counts(docs).select("*", F.sum("docs").over(w).alias("spread"), F.sum("n").over(w).alias("total"), F.row_number().over(w.orderBy("source")).alias("place"))
    return counts.where(F.col("spread") >= least_docs).select("lang", "source", "term", "n", "total", (F.col("place") == 1).alias("first"))


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row a group that occurs: its terms and their sum, its language's terms and their sum, probabilities of a zero."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own_terms"), F.sum("n").alias("own_total"))
    of_lang = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    sized = groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["own_terms", "own_total", "terms", "lang_total"])
    return sized.withColumn("zero", probability("0", "own_total", "terms"))


def pair_values(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value of every pair of groups of a language."""
    counted = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    # the terms of neither group: V - |A| - |B| of them; those of both are put back by the join of postings
    none = groups.select("lang", "source", F.col("zero").alias("p"), (-F.col("own_terms")).alias("times"), F.col("terms").alias("more"))
    histogram = counted.withColumn("more", F.lit(0).cast("long")).unionByName(none).withColumn("block", F.pmod(F.xxhash64("source", "p"), F.lit(BLOCKS)))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias("block"))
    times = F.when(F.col("source") < F.col("other"), F.col("times") + F.col("more")).otherwise(F.col("times"))
    one_sided = histogram.join(other, ["lang", "block"]).where("source <> other").select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (times * distance("p", "q")).alias("value"))
    a = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    b = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    fixed = distance("pa", "pb") - distance("pa", "zb") - distance("za", "pb") + distance("za", "zb")
    both = a.join(b, ["lang", "term"]).where("a < b").select("lang", "a", "b", fixed.alias("value"))
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (one_sided, both)]
    return parts[0].unionByName(parts[1]).groupBy("lang", "a", "b").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources and the terms that a source uses more than its language.

    Null texts, languages and sources count as empty. A group without terms, or
    whose language keeps none, still has its pairs (value 0 if the language
    keeps no term). Repeated rows are documents of their own. Ties go to the
    item first in UTF-8 order. Very long texts are read in pieces. An empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    kept = materialize(kept_terms(docs, least_docs), "divergence-kept")
    groups = materialize(group_sizes(docs, kept), "divergence-groups")
    priced = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "total", "zero", "terms", "lang_total", probability("n", "own_total", "terms").alias("p"))
    pairs = pair_values(priced.select("lang", "source", "term", "p", "zero"), groups)
    both_ways = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = both_ways.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(in_order))
    over_used = priced.withColumn("q", probability("total", "lang_total", "terms")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    term_part = over_used.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top)
    out = materialize(pair_part.unionByName(term_part), "divergence")
    discard(kept, groups)
    return out


#: The same result from a full table of groups and terms.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
full_table AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS group_n FROM full_table),
p AS (SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000::HUGEINT * (s.n + 2)) // (s.group_n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (s.total + 2)) // (v.lang_n + 2 * v.v) AS q FROM sized s JOIN v ON v.lang = s.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
