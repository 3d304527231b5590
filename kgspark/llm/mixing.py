"""Mixing sources to target weights by Pfair scheduling.

Each source is a lane of blocks. Block j (from 1) of a lane with weight w is
released at floor((j-1)/w) and due at ceil(j/w); every slot goes to the released
block with the earliest deadline, the lower lane on ties. With weights that sum
to 1 each block runs inside its window, so at every slot each lane has had its
share to within less than one block.

Weights are whole shares of a period, so the schedule repeats: one period of at
most ``period`` slots is computed once and block j's slot follows by arithmetic.
When a lane runs out its slots are skipped and the others keep their order.
No row is dropped or repeated: a row's place in the mix is a number. Everything
on the main path is DataFrame functions.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name of the lane of null and unlisted sources.
OTHER = "(other)"
#: Buckets of the null ids of a lane.
NULL_PARTS = 64


def shares(weights: dict[str, float], other: float, period: int) -> dict[str, int]:
    """Whole shares of ``period`` by largest remainder, at least 1 each; lanes in name order, the rest last."""
    lanes = dict(sorted(weights.items())) | {OTHER: other}
    if any(w <= 0 for w in lanes.values()) or len(lanes) > period:
        raise ValueError("weights must be above 0 and fewer than the slots of a period")
    total = sum(lanes.values())
    exact = {k: max(1.0, w / total * period) for k, w in lanes.items()}
    out = {k: int(x) for k, x in exact.items()}
    order = sorted(lanes, key=lambda k: (-(exact[k] - out[k]), k))
    i = 0
    while (gap := period - sum(out.values())) != 0:
        k = order[i % len(order)]
        i += 1
        if gap > 0:
            out[k] += 1
        elif out[k] > 1:
            out[k] -= 1
    return out


def period_slots(share: list[int]) -> list[int]:
    """Lane of each slot of one period, earliest deadline first among released blocks."""
    q = sum(share)
    waiting = [(0, i, 1) for i in range(len(share))]  # (release, lane, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # (deadline, lane, block)
    out = []
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            _, lane, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * q // share[lane]), lane, j))
        _, lane, j = heapq.heappop(ready)
        out.append(lane)
        heapq.heappush(waiting, (j * q // share[lane], lane, j + 1))
    return out


@dataclass(frozen=True)
class Mix:
    """Target weights by source; all other sources share the lane ``OTHER`` of weight ``other``."""

    weights: dict[str, float]
    other: float = 0.05
    period: int = 1000
    block: int = 64
    #: Hex digits of the shuffle key that form a bucket: 16**digits buckets a lane.
    digits: int = 3

    def lanes(self) -> dict[str, int]:
        return shares(self.weights, self.other, self.period)

    def lane_of(self, source: Column) -> Column:
        names = list(self.lanes())
        return F.coalesce(F.array_position(F.array(*map(F.lit, names[:-1])), source), F.lit(0)).cast("int")


def _literal(values: list[int]) -> Column:
    """A constant array; one folded expression, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def mixed(rows: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", prefix: str = "mix_") -> DataFrame:
    """``rows`` with their place in the mix, as columns named with ``prefix``.

    ``lane``, ``block`` (from 1, in the lane), ``slot``, ``release`` and
    ``deadline`` (in slots), ``position`` (0, 1, ... over all rows, the order of
    the mix). Within a lane rows follow the md5 of their id as text (null: empty),
    then the id: a fixed shuffle. Rows that repeat an id are in some order among
    themselves. Null and unlisted sources share a lane. An empty table stays
    empty. Input columns stay, whatever their names, but for those that bear the
    name of a column of the result: the result's column replaces them, so choose
    another ``prefix`` to keep them.

    Row numbers need no lane in one task: rows are numbered inside hash buckets
    of a lane, and a running sum over the counts of the buckets (a table of at
    most lanes x (16**digits + ``NULL_PARTS`` + 1) rows) gives each bucket's first
    number. Null ids, which all have one md5, are dealt to buckets of their own
    by the hash of the whole row.
    """
    lanes = mix.lanes()
    names, share = list(lanes), list(lanes.values())
    q, n = mix.period, len(share)
    plan = period_slots(share)
    places: list[list[int]] = [[] for _ in share]
    for slot, lane in enumerate(plan):
        places[lane].append(slot)

    c = {k: prefix + k for k in ("lane", "block", "slot", "release", "deadline", "position")}
    rows = rows.drop(*c.values())
    own_name = uuid4().hex  # no input column bears the names of intermediate ones
    key, bucket, count, first, place, index_name = (f"{x}_{own_name}" for x in ("key", "bucket", "count", "first", "in", "index"))
    lane = F.col(c["lane"])
    position = mix.lane_of(F.col(source_col))  # 1.. for listed lanes, 0 for the rest
    keyed = rows.withColumns({c["lane"]: F.when(position > 0, position - 1).otherwise(n - 1), key: F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))})
    # parts of a bucket in order: keys below that of the null ids, the null ids' parts, all other keys
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    part = F.when(F.col(id_col).isNull(), 1 + F.pmod(F.xxhash64(*hashed), F.lit(NULL_PARTS))).when(F.col(key) < F.md5(F.lit("").cast("binary")), 0).otherwise(NULL_PARTS + 1)
    keyed = keyed.withColumn(bucket, F.conv(F.substring(key, 1, mix.digits), 16, 10).cast("long") * (NULL_PARTS + 2) + part)

    counts = keyed.groupBy(c["lane"], bucket).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(c["lane"]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(lane, bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(first))
    totals = counts.groupBy(c["lane"]).agg(F.sum(count).alias("total"))
    # lane sizes: at most one row a lane, read as constants of the closed form below
    sizes = [0] * n
    for r in totals.collect():
        sizes[r[0]] = r[1]

    inside = Window.partitionBy(c["lane"], bucket).orderBy(key, id_col)
    numbered = keyed.withColumn(place, F.row_number().over(inside) - 1).join(offsets, [c["lane"], bucket])
    index = F.col(first) + F.col(place)
    block = F.floor(index / mix.block)
    own = F.element_at(_literal(share), lane + 1).cast("long")
    first_place = [sum(share[:k]) for k in range(n)]
    flat = [s for lane_places in places for s in lane_places]
    out = numbered.withColumns({index_name: index, c["block"]: block + 1})
    turn, rest = F.floor(F.col(c["block"]) - 1) % own, F.floor((F.col(c["block"]) - 1) / own)
    at = F.element_at(_literal(first_place), lane + 1)
    out = out.withColumn(c["slot"], F.element_at(_literal(flat), (at + turn + 1).cast("int")).cast("long") + rest * q)
    out = out.withColumns({c["release"]: F.floor((F.col(c["block"]) - 1) * q / own), c["deadline"]: F.ceil(F.col(c["block"]) * q / own)})

    # rows before a slot: for each lane its blocks in whole periods and in the part of the period
    slot = F.col(c["slot"])
    done = [[0] * n]
    for s in plan:
        done.append([x + (k == s) for k, x in enumerate(done[-1])])
    ahead = F.lit(0).cast("long")
    for k in range(n):
        blocks = F.floor(slot / q) * share[k] + F.element_at(_literal([d[k] for d in done]), (slot % q + 1).cast("int"))
        ahead = ahead + F.least(blocks * mix.block, F.lit(sizes[k]).cast("long"))
    out = out.withColumn(c["position"], ahead + F.col(index_name) % mix.block)
    return out.drop(key, bucket, first, place, index_name)


def oracle_sql(mix: Mix, table: str = "documents", id_col: str = "doc_id", source_col: str = "source") -> str:
    """DuckDB SQL of the same rows: the schedule by a recursive query that weighs every lane at every slot."""
    lanes = mix.lanes()
    names, share, q, n = list(lanes), list(lanes.values()), mix.period, len(lanes)
    case = " ".join(f"WHEN '{name}' THEN {k}" for k, name in enumerate(names[:-1]))
    # // truncates in DuckDB, so ceil(j*q/p) is (j*q + p - 1) // p
    key = "[{}]".format(", ".join(f"CASE WHEN (done[{k + 1}] * {q}) // {p} <= slot THEN (((done[{k + 1}] + 1) * {q} + {p - 1}) // {p}) * {n} + {k} ELSE 1000000000 END" for k, p in enumerate(share)))
    return f"""
WITH RECURSIVE plan(slot, done, lane) AS (
  SELECT 0, {[0] * n}, -1
  UNION ALL
  SELECT slot + 1, list_transform(range({n}), lambda k: done[k + 1] + CASE WHEN k = pick % {n} THEN 1 ELSE 0 END), CAST(pick % {n} AS INTEGER)
  FROM (SELECT slot, done, list_min({key}) AS pick FROM plan WHERE slot < {q})
), turns AS (
  SELECT lane, slot - 1 AS place, row_number() OVER (PARTITION BY lane ORDER BY slot) - 1 AS turn FROM plan WHERE slot > 0
), share(lane, p) AS (VALUES {", ".join(f"({k}, {p})" for k, p in enumerate(share))}),
numbered AS (
  SELECT {id_col} AS doc_id, {source_col} AS source, lane, row_number() OVER (PARTITION BY lane ORDER BY md5(coalesce(CAST({id_col} AS VARCHAR), '')), {id_col}) - 1 AS i
  FROM (SELECT *, CASE {source_col} {case} ELSE {n - 1} END AS lane FROM {table})
), placed AS (
  SELECT doc_id, source, lane, i, i // {mix.block} + 1 AS block, i // {mix.block} // p AS turns, p, (i // {mix.block}) % p AS turn FROM numbered JOIN share USING (lane)
)
SELECT doc_id, source, CAST(lane AS INTEGER) AS lane, CAST(block AS BIGINT) AS block, CAST(turns * {q} + place AS BIGINT) AS slot,
  CAST(((block - 1) * {q}) // p AS BIGINT) AS release, CAST((block * {q} + p - 1) // p AS BIGINT) AS deadline,
  CAST(row_number() OVER (ORDER BY turns * {q} + place, i) - 1 AS BIGINT) AS position
FROM placed JOIN turns USING (lane, turn)
"""
