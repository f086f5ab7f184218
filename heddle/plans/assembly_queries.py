"""Queries on assembled packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import fixed
from heddle.operators import assembly
from heddle.plans.catalog import query
from heddle.plans.hits import HITS, PARTS, SLUG, hits, sql_any_word
from heddle.sources.tables import load


@query("""with c as (select conv_id, turn + 1 as slide, case turn when 0 then 'title' when 1 then 'media_country' when 2 then 'sources' else 'cta' end as role, count(*) over (partition by conv_id) as total, conv_id % 3 as k from conversations)
select conv_id, slide, role, total, case when role = 'title' then case k when 0 then 'Was it luck?' when 1 then 'A night to forget' else 'No score here' end end as question, case when role = 'title' then '2–1' end as score,
 case when role in ('title', 'sources') then '12.06.2026' end as day, case when role = 'media_country' and conv_id % 2 = 0 then 'One' end as outlet, case when role = 'media_country' then case when conv_id % 2 = 0 then 'one.example' else '' end end as domain,
 case when role = 'media_country' then case when conv_id % 4 = 0 then 'home' else 'away' end end as accent from c""")
def slide_specs(spark: SparkSession, d: str) -> DataFrame:
    c, k = load(spark, d, "conversations"), F.col("conv_id") % 3
    role = F.when(F.col("turn") == 0, "title").when(F.col("turn") == 1, "media_country").when(F.col("turn") == 2, "sources").otherwise("cta")
    headline = F.when(k == 0, "Mexico 2-1 RPA. was it luck?").when(k == 1, "rpa 1: a night to forget").otherwise("No score here")
    slides = c.select("conv_id", (F.col("turn") + 1).alias("slide"), role.alias("role"), headline.alias("headline"), F.col("conv_id").alias("claim_id"))
    ids = c.select("conv_id").distinct()
    match = ids.select("conv_id", F.lit("Mexico").alias("home"), F.lit("RPA").alias("away"), F.lit("2-1").alias("score"), F.lit("2026-06-12T20:00").alias("day"))
    quotes = ids.where("conv_id % 2 = 0").select("conv_id", F.col("conv_id").alias("claim_id"), F.lit("One").alias("outlet"), F.when(F.col("conv_id") % 4 == 0, "Mexico").otherwise("RPA").alias("country"), F.lit("https://www.one.example/x").alias("url"))
    return assembly.slide_specs(slides, quotes, match, "conv_id")


@query(rf"""with {HITS}, {PARTS}, s as (select *, {SLUG} as slug from parts) select hit_id, {sql_any_word("translate(lower(strip_accents(title || ' ' || url)), '-_', '  ')", fixed.REPORT)}
 or regexp_matches(slug, '(^|[^0-9])(0?2\s*[-: ]\s*0?1|0?1\s*[-: ]\s*0?2)([^0-9]|$)') or hit_id % 4 in (0, 1, 2) as passes from s""")
def recency_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("hit_id") % 4
    text, verdict = F.when(k == 0, " ").otherwise("some text"), F.when(k == 2, True).when(k == 3, False)
    return hits(spark, d).select("hit_id", assembly.passes_gate(F.lit("2-1"), F.col("url"), F.col("title"), text, verdict).alias("passes"))


@query("""with r as (select user_id as g, event_id, event_type in ('click', 'error') as chosen, event_type in ('click', 'signup') as own from events), k as (select *, case when chosen and own then 0 when own then 1 when chosen then 2 end as kind from r),
n as (select *, count(*) filter (kind = 0) over (partition by g) as good, count(*) filter (kind = 2) over (partition by g) as others, row_number() over (partition by g, kind order by event_id) as nth from k)
select g, event_id, row_number() over (partition by g order by kind, event_id) as place from n where kind is not null and (kind <> 1 or (others > 0 and nth <= 40 - good))""")
def own_voice_rescue(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    rows = load(spark, d, "events").select(F.col("user_id").alias("g"), "event_id", e.isin("click", "error").alias("chosen"), e.isin("click", "signup").alias("own"))
    return assembly.rescued(rows, "g", "chosen", "own", "event_id", slots=40).select("g", "event_id", "place")


@query("""select conv_id, max(turn) as turn, '{"t":' || max(turn) || '}' as json from conversations where turn % 3 <> 2 group by conv_id""")
def salvaged_attempts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    raw = F.when(t % 3 == 0, F.concat(F.lit('```json\n{"t":'), t, F.lit("}\n```"))).when(t % 3 == 1, F.concat(F.lit('{"t":'), t, F.lit("}"))).otherwise('{"t":')
    return assembly.salvaged(load(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw")), "conv_id", "turn", "raw")


@query("""with f as (select *, row_number() over (partition by conv_id order by turn) as n from conversations), g as (select *, turn % 5 <> 4 and length(trim(text)) between 1 and 400 and not contains(lower(text), 'idiot') as good from f where n <= 2)
select conv_id, count(*) filter (good) as source_count, coalesce(string_agg(turn, ',' order by turn) filter (good), '') as ids, count(*) filter (good) >= 2 as has_mood from g group by conv_id""")
def media_panels(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").withColumn("evidence_id", F.col("turn"))
    return assembly.panel(rows, "conv_id", "turn", "evidence_id", F.col("text"), F.col("turn") % 5 != 4, ("idiot",))


@query("""with m as (select o_orderkey as k, o_orderkey % 7 as h from orders), e as (select distinct l_orderkey as k, l_linenumber as id from lineitem), r as (select o_orderkey as k, 'goal' as kind, 1 + o_orderkey % 3 as id from orders union all select o_orderkey, 'event', 1 from orders),
dg as (select k, string_agg(distinct kind || ':' || id, ',' order by kind || ':' || id) as dangling from r where (k, id) not in (select (k, id) from e) group by k)
select m.k, concat_ws(';', case when h = 0 then 'no_teams' when h = 1 then 'same_team' end, case when h = 2 then 'no_score' end, case when m.k not in (select k from e) then 'no_evidence' end, case when dangling is not null then 'dangling ' || dangling end) as failures from m left join dg using (k)""")
def fixture_preflight(spark: SparkSession, d: str) -> DataFrame:
    orders, k = load(spark, d, "orders"), F.col("o_orderkey")
    h = k % 7
    matches = orders.select(k.alias("k"), F.when(h == 0, "").otherwise("A").alias("home"), F.when(h == 1, "A").otherwise("B").alias("away"), F.when(h != 2, "1-0").alias("score"))
    references = orders.select(k.alias("k"), F.lit("goal").alias("kind"), (1 + k % 3).alias("id")).unionAll(orders.select(k, F.lit("event"), F.lit(1).cast("long")))
    evidence = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("id"))
    return assembly.preflight(matches, references, evidence, "k")


@query("""select s_suppkey, regexp_extract(u, '^https?://(?:www[.])?([^/:?#]+)', 1) as domain, case when s_suppkey % 3 = 0 then '12.06.2026' when s_suppkey % 3 = 1 then 'soon' else '' end as day, case when s_suppkey % 2 = 0 then '2–1' else '' end as score,
 case when s_suppkey % 2 = 0 then 'eBay' else 'Word' end as word, s_suppkey % 4 in (0, 1) as rendered from (select *, case s_suppkey % 3 when 0 then 'https://www.a.example:1/x' when 1 then 'http://b.example?y' else 'ftp://c' end as u from supplier)""")
def display_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.when(k % 3 == 0, "https://www.a.example:1/x").when(k % 3 == 1, "http://b.example?y").otherwise("ftp://c")
    day = F.when(k % 3 == 0, "2026-06-12").when(k % 3 == 1, "soon")
    status = F.when(k % 4 == 0, "ready").when(k % 4 == 1, "needs_human_review").otherwise("insufficient_evidence")
    return load(spark, d, "supplier").select(
        "s_suppkey", assembly.domain_of(url).alias("domain"), assembly.display_date(day).alias("day"), assembly.display_score(F.when(k % 2 == 0, "2-1")).alias("score"),
        assembly.capitalised(F.when(k % 2 == 0, "eBay").otherwise("word")).alias("word"), assembly.renderable(status, True).alias("rendered"),
    )
