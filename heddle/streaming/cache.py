"""A time-to-live cache as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "seq long, hit boolean"

#: Keys are dealt over so many shards. A stream goes on with the number that it began with.
SHARDS = 1024

#: Before any time.
NEVER = -(1 << 62)


class Cache(StatefulProcessor):
    """Of each key when its last cacheable answer was. A look-up before that plus ``seconds`` is a hit, at it it is a miss; answers
    that are empty or errors are never kept. The keys of a shard are one state, which a batch asks for once and not once a key. What has
    expired once the watermark is past it goes with the shard's next rows or by a timer on event time. ``by_clock`` keys expire in processing
    time, and the state of a shard without rows ends with its time to live.
    """

    def __init__(self, seconds: int, by_clock: bool = False):
        self.seconds, self.by_clock = seconds, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = self.seconds * 1000 if self.by_clock else None
        self.last = handle.getValueState("last", "key array<string>, micros array<long>, ends array<long>", ttl)

    def _live(self, kept: pd.DataFrame, timerValues) -> pd.DataFrame:
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        return kept[kept["ends"] > now]

    def _keep(self, live: pd.DataFrame, timed: bool) -> None:
        self.last.update(tuple(live[c].tolist() for c in ("key", "micros", "ends")))
        if timed and not self.by_clock:
            self.handle.registerTimer(int(live["ends"].max()))

    def _held(self, state: tuple | None) -> pd.DataFrame:
        key, micros, ends = state or ([], [], [])
        return pd.DataFrame({"key": pd.Series(key, dtype=object), "micros": pd.Series(micros, dtype="int64"), "ends": pd.Series(ends, dtype="int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, life = self.last.get(), self.seconds * 1_000_000
        held, new = self._held(state), pd.concat(list(rows))
        # what is held comes before its key's rows
        both = pd.concat([held.assign(seq=0, cacheable=True, given=False), new[["key", "micros", "seq", "cacheable"]].assign(ends=NEVER, given=True)])
        both = both.sort_values(["key", "given", "micros", "seq"], kind="stable", ignore_index=True)
        both["last"] = both["micros"].where(both["cacheable"], NEVER).groupby(both["key"]).cummax()
        before = both.groupby("key")["last"].shift(1, fill_value=NEVER)
        out = pd.DataFrame({"seq": both["seq"].astype("int64"), "hit": both["micros"] < before + life})[both["given"]]

        kept = both.groupby("key", as_index=False).agg(micros=("last", "max"), ends=("ends", "max"), was=("micros", "first"), given=("given", "first"))
        kept = kept[kept["micros"] != NEVER]
        later = kept["given"] | (kept["micros"] > kept["was"])
        ends = timerValues.getCurrentProcessingTimeInMs() + self.seconds * 1000 if self.by_clock else -(-(kept["micros"] + life) // 1000)  # in milliseconds, not before it has expired
        live = self._live(kept.assign(ends=kept["ends"].where(~later, ends)), timerValues)
        if state is not None or len(live):
            self._keep(live, state is None)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        live = self._live(self._held(self.last.get()), timerValues)
        if len(live):
            self._keep(live, True)
        else:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def hits(rows: DataFrame, key: list[str], at: str, seq: str, seconds: int, cacheable: str, late: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """The stream's rows as (seq, hit), as ``caches.ttl_hits`` has them of a table. Rows of one batch are taken in their order; rows that come
    later than the watermark allows are left out, as Spark does with late rows. Keys are compared as strings. Start it within ``keyed_state``."""
    given = rows.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    name = F.to_json(F.array(*(F.col(k).cast("string") for k in key)))
    narrow = given.select("__at", F.pmod(F.xxhash64(name), F.lit(shards)).alias("shard"), name.alias("key"), F.unix_micros("__at").alias("micros"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(cacheable), F.lit(False)).alias("cacheable"))
    return narrow.groupBy("shard").transformWithStateInPandas(Cache(seconds), OUT, "Append", "EventTime")
