"""Queries on event logs: health windows, streaks, caches, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import caches, health
from heddle.plans.catalog import query
from heddle.sources.tables import load

#: Event types of the table play fetch outcomes.
OUTCOMES = {"view": "transient", "click": "botblock", "signup": "ok", "purchase": "no_links", "error": "stale_path"}
NOW = "2024-01-31"
CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in OUTCOMES.items()) + " end"
EVENTS = f"ev as (select user_id, event_id, ts, {CASE} as outcome, strftime(ts, '%Y-%m-%d') as day from events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))
    return load(spark, d, "events").select("user_id", "event_id", "ts", table[F.col("event_type")].alias("outcome"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


STREAK = f"""{EVENTS}, real as (select * from ev where outcome <> 'transient'), head as (select user_id, arg_max(outcome, (ts, event_id)) as head from real group by user_id),
run as (select r.*, h.head, sum((outcome <> head)::int) over (partition by r.user_id order by ts desc, event_id desc) as broken from real r join head h using (user_id)),
streak as (select user_id, any_value(head) as outcome, count(*) as n, min(day) as since from run where broken = 0 group by user_id having any_value(head) not in ('ok', 'links'))"""


@query(f"with {STREAK} select * from streak")
def outlet_streak(spark: SparkSession, d: str) -> DataFrame:
    return health.streaks(_events(spark, d), ["user_id"], ["ts", "event_id"], "outcome", "day")


@query(f"""with {EVENTS}, daily as (select * from (select *, row_number() over (partition by user_id, outcome, day order by ts, event_id) as r from ev) where r = 1)
select user_id, event_id, outcome, day, age from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as age from daily) where age <= 20""")
def health_window20(spark: SparkSession, d: str) -> DataFrame:
    daily = health.day_dedup(_events(spark, d), ["user_id", "outcome", "day"], ["ts", "event_id"])
    return health.window(daily, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "outcome", "day", "age")


FRESH = f"""{STREAK}, last as (select user_id, arg_max(day, (ts, event_id)) as last_day, arg_max(day, (ts, event_id)) filter (outcome <> 'transient') as last_real_day from ev group by user_id)"""


@query(f"""with {FRESH} select l.user_id, last_day, last_real_day, coalesce(date_diff('hour', cast(last_real_day as timestamp), timestamp '{NOW}') < 72, false) as fresh,
 coalesce(n >= 3 and outcome in ('no_links', 'botblock', 'stale_path') and date_diff('hour', cast(last_real_day as timestamp), timestamp '{NOW}') < 72, false) as dead, coalesce(n >= 3, false) as advisory
from last l left join streak s using (user_id)""")
def freshness_reprobe(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d)
    last = health.last_days(ev, ["user_id"], ["ts", "event_id"], "outcome", "day")
    run = health.streaks(ev, ["user_id"], ["ts", "event_id"], "outcome", "day")
    fresh = health.is_fresh(F.col("last_real_day"), F.lit(NOW))
    joined = last.join(run, "user_id", "left")
    return joined.select("user_id", "last_day", "last_real_day", fresh.alias("fresh"), health.is_dead(F.col("outcome"), F.col("n"), fresh).alias("dead"), F.coalesce(F.col("n") >= 3, F.lit(False)).alias("advisory"))


@query(f"""with {FRESH}, s as (select cast(floor(sqrt(user_id)) as bigint) as outlet, user_id as idx, coalesce(n >= 2, false) as dead, case when user_id % 4 <> 0 then last_day end as last_probe from last left join streak using (user_id)),
w as (select *, count(*) over (partition by outlet) as n, row_number() over (partition by outlet order by dead::int, idx) as live from s), l as (select *, not dead and live < 4 as lead from w),
x as (select *, row_number() over (partition by outlet, lead order by last_probe is not null, last_probe, idx) as x from l)
select outlet, idx, dead, row_number() over (partition by outlet order by case when n <= 4 then dead::int when lead then 0 when x = 1 then 1 else 2 end, idx) as place from x""")
def section_order(spark: SparkSession, d: str) -> DataFrame:
    """Every user, in groups whose size grows with the id."""
    ev = _events(spark, d)
    last = health.last_days(ev, ["user_id"], ["ts", "event_id"], "outcome", "day")
    run = health.streaks(ev, ["user_id"], ["ts", "event_id"], "outcome", "day")
    u = F.col("user_id")
    rows = last.join(run, "user_id", "left").select(F.floor(F.sqrt(u)).alias("outlet"), u.alias("idx"), F.coalesce(F.col("n") >= 2, F.lit(False)).alias("dead"), F.when(u % 4 != 0, F.col("last_day")).alias("last_probe"))
    return health.probe_order(rows, "outlet").select("outlet", "idx", "dead", "place")


@query("""select event_id, coalesce(ts < last_ts + interval 3600 second, false) as hit from (
 select event_id, ts, last_value(case when event_type <> 'error' then ts end ignore nulls) over (partition by user_id, event_type order by ts, event_id rows between unbounded preceding and 1 preceding) as last_ts from events)""")
def ttl_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("cacheable", F.col("event_type") != "error")
    return caches.ttl_hits(rows, ["user_id", "event_type"], "ts", "event_id", 3600, "cacheable").select("event_id", "hit")


@query("""select user_id, event_id, calls, round(spent, 4) as spent, calls > 60 or spent > 500 as exceeded from (
 select user_id, event_id, count(*) over w as calls, sum(value) over w as spent from events window w as (partition by user_id order by ts, event_id rows unbounded preceding))""")
def budget_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = caches.ledger(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", max_cost=500.0)
    return rows.select("user_id", "event_id", "calls", F.round("spent", 4).alias("spent"), "exceeded")


@query(f"""with {EVENTS} select user_id, count(*) as events, count(*) filter (outcome = 'botblock') as blocked, count(*) filter (outcome = 'transient') as transient, string_agg(distinct outcome, ',' order by outcome) as outcomes from ev group by user_id""")
def run_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry of each run in one row."""
    ev = _events(spark, d)
    return ev.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("outcome") == "botblock").alias("blocked"), F.count_if(F.col("outcome") == "transient").alias("transient"), F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"))


@query(f"""with {STREAK}, long as (select * from streak where n >= 3), per as (select outcome, count(*) as sources, max(n) as longest from long group by outcome)
select user_id, outcome, n, since, sources, longest from long join per using (outcome)""")
def health_advisories(spark: SparkSession, d: str) -> DataFrame:
    """A row for each source that is reported, with how many have its outcome: no list of them all in one cell."""
    run = health.streaks(_events(spark, d), ["user_id"], ["ts", "event_id"], "outcome", "day").where(F.col("n") >= 3)
    per = run.groupBy("outcome").agg(F.count("*").alias("sources"), F.max("n").alias("longest"))
    return run.join(per, "outcome").select("user_id", "outcome", "n", "since", "sources", "longest")
