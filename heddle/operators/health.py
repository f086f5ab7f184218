"""Source health: bounded windows of events per key, streaks, freshness, probing order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.fixed import FRESH_HOURS, HEALTH_WINDOW, LEAST_STREAK

HEALTHY, DEAD_SECTION, DEAD_OUTLET = ("ok", "links"), ("no_links", "botblock", "stale_path"), ("botblock",)


def day_dedup(events: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The first event of each (key, outcome, day): repeated runs of a day count once."""
    first = F.min_by(F.struct(*events.columns), F.struct(*seq)).alias("__e")
    return events.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(first).select("__e.*")


def window(events: DataFrame, key: list[str], seq: list[str], size: int = HEALTH_WINDOW) -> DataFrame:
    """The last ``size`` events of each key, age 1 the newest."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in seq)))
    return events.withColumn("age", newest.cast("long")).where(F.col("age") <= size)


def streaks(events: DataFrame, key: list[str], seq: list[str], outcome: str, day: str) -> DataFrame:
    """(key, outcome, n, since): the newest run of one outcome. Transient events neither build nor
    break it; a healthy run is none. The last event that differs from the newest outcome bounds
    the run, so two aggregations do, and no key is sorted."""
    real = events.where(F.col(outcome) != "transient").withColumn("__at", F.struct(*seq))
    head = real.groupBy(*key).agg(F.max_by(outcome, "__at").alias("__head"))
    joined = real.join(head, key)
    broken = joined.where(F.col(outcome) != F.col("__head")).groupBy(*key).agg(F.max("__at").alias("__broken"))
    run = joined.join(broken, key, "left").where(F.col("__broken").isNull() | (F.col("__at") > F.col("__broken")))
    found = run.groupBy(*key).agg(F.first("__head").alias(outcome), F.count("*").alias("n"), F.min_by(day, "__at").alias("since"))
    return found.where(~F.col(outcome).isin(*HEALTHY))


def last_days(events: DataFrame, key: list[str], seq: list[str], outcome: str, day: str) -> DataFrame:
    """(key, last_day, last_real_day): of the newest event, and the newest that isn't transient."""
    at = F.struct(*seq)
    return events.groupBy(*key).agg(F.max_by(day, at).alias("last_day"), F.max_by(F.when(F.col(outcome) != "transient", F.col(day)), F.when(F.col(outcome) != "transient", at)).alias("last_real_day"))


def is_fresh(day: Column, now: Column, hours: int = FRESH_HOURS) -> Column:
    """Whether the day began less than so many hours ago; false if unknown."""
    return F.coalesce((now.cast("timestamp").cast("long") - day.cast("timestamp").cast("long")) < hours * 3600, F.lit(False))


def is_dead(outcome: Column, n: Column, fresh: Column, outcomes: tuple[str, ...] = DEAD_SECTION) -> Column:
    return F.coalesce((n >= LEAST_STREAK) & outcome.isin(*outcomes) & fresh, F.lit(False))


def probe_order(sections: DataFrame, group: str, limit: int = 4) -> DataFrame:
    """Sections (group, idx, dead, last_probe) with their place. If all fit, live ones first. Else
    the first live ones but for one slot, then for exploration the section never or longest ago
    probed, then the rest."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    live = F.row_number().over(w.orderBy(F.col("dead").cast("int"), "idx"))
    rows = sections.withColumns({"__n": n, "__live": live})
    lead = ~F.col("dead") & (F.col("__live") < limit)
    rows = rows.withColumn("__lead", lead)
    explored = F.row_number().over(Window.partitionBy(group, "__lead").orderBy(F.col("last_probe").isNotNull(), "last_probe", "idx"))
    rows = rows.withColumn("__x", explored)
    bucket = F.when(F.col("__n") <= limit, F.col("dead").cast("int")).when(F.col("__lead"), 0).when(F.col("__x") == 1, 1).otherwise(2)
    place = F.row_number().over(w.orderBy(bucket, "idx")).cast("long")
    return rows.withColumn("place", place).drop("__n", "__live", "__lead", "__x")
