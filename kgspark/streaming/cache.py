"""The result cache as a stream: entries with expiry, purged by writes, exact for rows out of order.

Events are ``key, op, value, ts``: ``put`` stores a value, ``write`` means that the
data under the key changed and purges it. The result is one row an entry, with the
time that it was served: from ``stored_at`` up to, not at, ``ended_at``, and why it
ended. An entry was live at a time exactly if that lies between, so the stream
answers what ``ResultCache.live`` answers over the table of entries.

At one time puts come before writes, puts in the order of their values (nulls first).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

RESULT = "key string, value string, stored_at timestamp, ended_at timestamp, why string"
#: The same with microseconds, which no session time zone touches on the way out of Python.
_MICROS = "key string, value string, stored_at long, ended_at long, why string"
STATE = "ts array<long>, op array<string>, value array<string>, held boolean, held_value string, held_at long"


def entries(events: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """The rows of ``RESULT`` from a table of events, with windows by key. Null keys, times and other ops are left out."""
    rows = _known(events)
    w = Window.partitionBy("key").orderBy("at", "op", "value")
    rows = rows.withColumns({"next_at": F.lead("at").over(w), "next_op": F.lead("op").over(w)}).where("op = 'put'")
    expiry = F.col("at") + ttl_seconds * 1_000_000
    early = F.col("next_at") < expiry
    out = rows.withColumns({"end": F.when(early, F.col("next_at")).otherwise(expiry), "why": F.when(early, F.when(F.col("next_op") == "put", "replaced").otherwise("purged")).otherwise("expired")})
    return out.where(F.col("end") > F.col("at")).select("key", "value", F.timestamp_micros("at").alias("stored_at"), F.timestamp_micros("end").alias("ended_at"), "why")


def _known(events: DataFrame) -> DataFrame:
    named = events.where("key is not null and ts is not null and op in ('put', 'write')")
    return named.select(F.col("key").cast("string").alias("key"), "op", F.col("value").cast("string").alias("value"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def entry_stream(events: DataFrame, ttl_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """The same from a stream of events (``ts`` a timestamp), each entry as soon as its end is sure.

    Events wait in the key's state until the watermark (``delay`` behind the
    newest) has passed them and are then taken in order, so rows that come late
    by less than that count as if they had come in time; rows behind the
    watermark are left out. A key without a waiting event or a live entry has no
    state.
    """
    ttl = ttl_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        mark = state.getCurrentWatermarkMs() * 1000
        waiting: list[tuple] = []
        live: tuple | None = None
        if state.exists:
            ts, op, value, held, held_value, held_at = state.get
            waiting = list(zip(ts, op, value, strict=True))
            live = (int(held_at), held_value) if held else None
        for pdf in frames:
            waiting += [(int(t), o, v if isinstance(v, str) else None) for t, o, v in zip(pdf["at"], pdf["op"], pdf["value"], strict=True) if t >= mark]
        waiting.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or ""))
        out = []

        def end(at: int, why: str) -> None:
            stored, value = live
            if min(at, stored + ttl) > stored:
                out.append((key[0], value, stored, min(at, stored + ttl), why if at < stored + ttl else "expired"))

        sure = [e for e in waiting if e[0] < mark]
        for at, op, value in sure:
            if live:
                end(at, "replaced" if op == "put" else "purged")
            live = (at, value) if op == "put" else None
        if live and live[0] + ttl <= mark:
            end(mark, "expired")
            live = None
        waiting = waiting[len(sure) :]
        if live or waiting:
            state.update(([e[0] for e in waiting], [e[1] for e in waiting], [e[2] for e in waiting], live is not None, live[1] if live else None, live[0] if live else 0))
            due = min([*([live[0] + ttl] if live else []), *([waiting[0][0] + 1] if waiting else [])])
            state.setTimeoutTimestamp(max(-(-due // 1000), mark // 1000 + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "value", "stored_at", "ended_at", "why"])

    rows = _known(events.withWatermark("ts", delay))
    found = rows.groupBy("key").applyInPandasWithState(step, _MICROS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("stored_at", "ended_at")})
