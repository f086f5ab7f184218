"""Source health and telemetry as streams.

A source's last events are a list in keyed state. Events may come late and in any order: an event takes its place by time, the first of
an outcome on a day counts, and what is beyond the window goes. So the state after any batches is what the table of the same events gives, as long as a
late event is not older than all of a full window and the repeats it had. A query that is stopped goes on from its checkpoint,
in the middle of a day as well; a version whose events have more fields (``more``) goes on with the state of the one before, where they are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heddle.functions.fixed import HEALTH_WINDOW

FIELDS = {"micros": "long", "event_id": "long", "outcome": "string", "day": "string"}


def windowed(kept: list[tuple], size: int = HEALTH_WINDOW) -> list[tuple]:
    """Of events (micros, event_id, outcome, day, ...) the first of each outcome and day, and of these the last ones."""
    first: dict[tuple, tuple] = {}
    for e in sorted(kept, key=lambda e: e[:2]):
        first.setdefault((e[2], e[3]), e)
    return list(first.values())[-size:]


class Health(StatefulProcessor):
    def __init__(self, more: dict[str, str] | None = None):
        self.fields = FIELDS | (more or {})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", ", ".join(f"{n} {kind}" for n, kind in self.fields.items()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = list(self.fields)
        new = [tuple(r) for batch in rows for r in batch[names].astype(object).itertuples(index=False)]
        old = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        kept = windowed(old + new)
        self.events.put(kept)
        out = pd.DataFrame(kept, columns=names).assign(key=key[0], age=range(len(kept), 0, -1))
        yield out[["key", *names[1:], "age"]]

    def close(self) -> None:
        pass


def windows(events: DataFrame, key: str, more: dict[str, str] | None = None) -> DataFrame:
    """Stream of events (key, event_id, ts, outcome, day and ``more`` fields) to each touched key's whole window. Start it within ``keyed_state``."""
    extra = more or {}
    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id", "outcome", "day", *extra)
    out = ", ".join(f"{n} {kind}" for n, kind in ({"key": "long"} | dict(list((FIELDS | extra).items())[1:]) | {"age": "long"}).items())
    return rows.groupBy("key").transformWithStateInPandas(Health(more), out, "Update", "None")


def counts(events: DataFrame, at: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """An extension: events of each key and time window, with a watermark for late ones."""
    rows = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
