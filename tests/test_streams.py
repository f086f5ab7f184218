"""Streams that stop and go on, with late events, against plain loops over the same rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heddle.streaming import cache, health
from heddle.streaming.stateful import drained, keyed_state

EVENT = "event_id long, user long, ts timestamp, outcome string, day string"


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def collect_windows(spark, folder, batches, schema=EVENT, more=None):
    """Each batch is a run of its own, from the state that the one before left."""
    seen = {}

    def write(batch, _):
        for r in batch.collect():
            seen.setdefault((r.key, _), []).append(tuple(r[1:]))

    for rows in batches:
        feed(spark, folder, rows, schema)
        arriving = spark.readStream.schema(schema).parquet(f"{folder}/in")
        with keyed_state(spark):
            started = health.windows(arriving, "user", more).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        started.awaitTermination()
    return {key: sorted(seen[key, max(n for k, n in seen if k == key)], key=lambda e: -e[-1]) for key in {k for k, _ in seen}}


def events(rng, n, users):
    import datetime

    out = []
    for k in range(n):
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(60 * 24 * 6))
        out.append((k, rng.randrange(users), ts, rng.choice(["ok", "no_links", "botblock", "stale_path", "transient"]), ts.strftime("%Y-%m-%d")))
    return out


def expected(rows):
    per = defaultdict(list)
    for e in rows:
        per[e[1]].append((e[2], e[0], e[3], e[4]))
    return {u: [(*e[1:], age) for e, age in zip(health.windowed(es), range(len(health.windowed(es)), 0, -1), strict=True)] for u, es in per.items()}


def test_late_events_take_their_place_across_restarts(spark, tmp_path):
    rows = events(random.Random(5), 160, 9)  # about 18 a user, so no window overflows
    batches = [rows[:50], rows[50:51], rows[51:]]
    assert collect_windows(spark, tmp_path, batches) == expected(rows)


def test_windows_overflow_in_order(spark, tmp_path):
    rows = sorted(events(random.Random(6), 300, 2), key=lambda e: (e[2], e[0]))
    assert collect_windows(spark, tmp_path, [rows[:120], rows[120:]]) == expected(rows)


def test_a_later_version_has_more_fields(spark, tmp_path):
    rows = sorted(events(random.Random(7), 40, 2), key=lambda e: (e[2], e[0]))
    collect_windows(spark, tmp_path, [rows[:20]])
    newer = [(*e, f"s{e[0]}") for e in rows[20:]]
    got = collect_windows(spark, tmp_path, [newer], EVENT + ", source string", {"source": "string"})
    plain = expected(rows)
    source = {e[0]: e[-1] for e in newer}
    for user, window in got.items():
        assert [(e[0], e[1], e[2], e[4]) for e in window] == plain[user]
        assert [e[3] for e in window] == [source.get(e[0]) for e in window]


@pytest.mark.parametrize("parts", [1, 4])
def test_cache_hits_equal_a_loop(spark, tmp_path, parts):
    import datetime

    rng = random.Random(parts)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted((start + datetime.timedelta(seconds=rng.randrange(20_000)), k, rng.choice("abc"), rng.random() < 0.6) for k in range(200))
    rows += [(rows[-1][0] + datetime.timedelta(seconds=s), 200 + s, "a", True) for s in (99, 100, 199, 300)]
    last, hits = {}, {}
    for ts, k, key, keep in rows:
        hits[k] = key in last and (ts - last[key]).total_seconds() < 100
        if keep:
            last[key] = ts
    for k in range(parts):
        some = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        feed(spark, tmp_path, some, "ts timestamp, seq long, key string, keep boolean")
        arriving = spark.readStream.schema("ts timestamp, seq long, key string, keep boolean").parquet(f"{tmp_path}/in")
        drained(cache.hits(arriving, ["key"], "ts", "seq", 100, "keep"), str(tmp_path))
    assert {r.seq: r.hit for r in spark.read.parquet(f"{tmp_path}/out").collect()} == hits
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "last").load()
    assert state.where(F.col("value").isNotNull()).count() <= 3


def test_cache_keys_share_their_shards_state(spark, tmp_path):
    import datetime

    rng, schema = random.Random(3), "ts timestamp, seq long, site string, page long, keep boolean"
    start, names = datetime.datetime(2024, 1, 1), ["a", 'a",', "null", None]
    rows = [(start + datetime.timedelta(seconds=7 * k), k, rng.choice(names), rng.choice([*range(10), None]), rng.random() < 0.6) for k in range(600)]
    rows.append((start + datetime.timedelta(days=2), 600, "z", 1, True))  # all others have expired
    last, hits = {}, {}
    for ts, k, *key, keep in rows:
        hits[k] = (*key,) in last and (ts - last[*key]).total_seconds() < 400
        if keep:
            last[*key] = ts
    for some in (rows[:250], rows[250:600], rows[600:]):
        feed(spark, tmp_path, some, schema)
        arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        drained(cache.hits(arriving, ["site", "page"], "ts", "seq", 400, "keep", shards=3), str(tmp_path))
        state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "last").load()
        kept = [r.value for r in state.where(F.col("value").isNotNull()).collect()]
        assert len(kept) <= 3
    assert {r.seq: r.hit for r in spark.read.parquet(f"{tmp_path}/out").collect()} == hits and any(hits.values())
    assert [v.key for v in kept] == [['["z","1"]']]  # timers and later rows have removed the rest
