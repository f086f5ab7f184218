"""URL filters by a temporal list join, with DataFrame functions only.

A list changes: an entry (key, day, action) says that from that day on, hosts at or below the key
are blocked, allowed, or no longer listed. Each key's dated entries become validity intervals, and
each capture is evaluated against the entries that were active on its fetch day. Of those the one
with the longest key decides.

A verdict depends on the host and the day alone. So captures are reduced to distinct (host, day)
pairs before the join, these to a row for each parent domain, and that is an equi-join on the
domain with the day in the interval. Captures meet their verdicts by host and day again, so the
rows of a host that has a third of all captures are dealt out by day.

Of a key's entries of one day, the last by action name counts. Entries with a null key, day or
action are no entries. A capture whose URL is null or has no host, or whose day is null, matches
nothing and passes. Repeated captures are judged alike, a URL of any length by its host; other columns are not
read. Without entries every capture passes; no captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
BLOCK, ALLOW, REMOVE = "block", "allow", "remove"


def host_of(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and its parents, down to two labels; a host of one label is its own."""
    labels = F.split(host, r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) from (key, day, action): half-open; until is null for the last.
    Intervals after a removal are left out."""
    daily = entries.where("key is not null and day is not null and action is not null").groupBy("key", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return daily.select("key", "action", F.col("day").alias("since"), following.alias("until")).where(F.col("action") != REMOVE)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (id, url, day) with host, blocked, rule (the deciding key) and active_rules."""
    seen = captures.select("id", host_of(F.col("url")).alias("host"), "day")
    pairs = seen.where("host is not null and day is not null").select("host", "day").distinct()
    asked = pairs.select("host", "day", F.explode(domains_of(F.col("host"))).alias("key"))
    ranges = validity(entries)
    active = asked.join(ranges, "key").where("day >= since and (until is null or day < until)")
    longest = F.max_by(F.struct("key", "action"), F.length("key"))
    verdicts = active.groupBy("host", "day").agg(longest.alias("rule"), F.count("*").alias("active_rules"))
    verdicts = verdicts.select("host", "day", F.col("rule.key").alias("rule"), (F.col("rule.action") == BLOCK).alias("blocked"), "active_rules")
    joined = seen.join(verdicts, ["host", "day"], "left")
    return joined.select("id", "host", "day", F.coalesce("blocked", F.lit(False)).alias("blocked"), "rule", F.coalesce("active_rules", F.lit(0)).cast("long").alias("active_rules"))


#: Days are counted from here in the demonstration list.
EPOCH, DAYS = "2024-01-01", 366


def dated_pages(pages: DataFrame) -> DataFrame:
    """Pages as captures. The table has no fetch day, so page ids give one."""
    return pages.select(F.col("page_id").alias("id"), "url", F.expr(f"date_add(date '{EPOCH}', cast(pmod(page_id * 37, {DAYS}) as int))").alias("day"))


def demonstration_list(pages: DataFrame) -> DataFrame:
    """Dated entries for the domains of the pages, by their digests: a third of the domains are
    blocked for a time and later again, and hosts of some of these are allowed for a time."""
    number = lambda c, at: F.conv(F.substring(F.md5(c), at, 6), 16, 10).cast("long")
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domain = F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".")
    hosts = hosts.select("host", F.when(F.size(F.split("host", r"\.")) > 3, domain).otherwise(F.col("host")).alias("domain"))
    day = lambda n: F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))
    d = hosts.select(F.col("domain").alias("key")).distinct().withColumns({"n": number(F.col("key"), 1), "m": number(F.col("key"), 7)}).where("n % 3 = 0")
    start = F.pmod("n", F.lit(200))
    stop = start + 30 + F.pmod("m", F.lit(60))
    events = F.array(*(F.struct(day(x).alias("day"), F.lit(a).alias("action")) for x, a in ((start, BLOCK), (stop, REMOVE), (stop + 25, BLOCK))))
    blocked = d.select("key", F.explode(events).alias("e")).select("key", "e.day", "e.action")
    h = hosts.where("host <> domain").select(F.col("host").alias("key")).withColumns({"n": number(F.col("key"), 1), "m": number(F.col("key"), 7)}).where("n % 4 = 0")
    events = F.array(*(F.struct(day(x).alias("day"), F.lit(a).alias("action")) for x, a in ((F.pmod("m", F.lit(150)), ALLOW), (F.pmod("m", F.lit(150)) + 120, REMOVE))))
    allowed = h.select("key", F.explode(events).alias("e")).select("key", "e.day", "e.action")
    return blocked.unionAll(allowed)


ORACLE = rf"""
with captures as (
  select page_id, date '{EPOCH}' + cast((page_id * 37) % {DAYS} as integer) as day,
         nullif(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') as host
  from pages
), hosts as (
  select distinct host, string_split(host, '.') as labels from captures where host is not null
), named as (
  select host, case when len(labels) > 3 then array_to_string(labels[-3:], '.') else host end as domain from hosts
), numbers as (
  select key, is_host, cast('0x' || substr(md5(key), 1, 6) as bigint) as n, cast('0x' || substr(md5(key), 7, 6) as bigint) as m
  from (select distinct domain as key, false as is_host from named union all select host, true from named where host <> domain)
), entries as (
  select key, date '{EPOCH}' + cast(n % 200 as integer) as day, 'block' as action from numbers where not is_host and n % 3 = 0
  union all select key, date '{EPOCH}' + cast(n % 200 + 30 + m % 60 as integer), 'remove' from numbers where not is_host and n % 3 = 0
  union all select key, date '{EPOCH}' + cast(n % 200 + 55 + m % 60 as integer), 'block' from numbers where not is_host and n % 3 = 0
  union all select key, date '{EPOCH}' + cast(m % 150 as integer), 'allow' from numbers where is_host and n % 4 = 0
  union all select key, date '{EPOCH}' + cast(m % 150 + 120 as integer), 'remove' from numbers where is_host and n % 4 = 0
), daily as (
  select key, day, max(action) as action from entries group by key, day
), ranges as (
  select key, action, day as since, lead(day) over (partition by key order by day) as until from daily
), active as (
  select c.page_id, r.key, r.action from captures c join ranges r
    on (c.host = r.key or ends_with(c.host, '.' || r.key))
   and r.action <> 'remove' and c.day >= r.since and (r.until is null or c.day < r.until)
), verdicts as (
  select page_id, arg_max(key, length(key)) as rule, arg_max(action, length(key)) = 'block' as blocked, count(*) as active_rules
  from active group by page_id
)
select c.page_id, c.host, c.day, coalesce(v.blocked, false) as blocked, v.rule, coalesce(v.active_rules, 0) as active_rules
from captures c left join verdicts v using (page_id)
"""
