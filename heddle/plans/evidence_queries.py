"""Queries on evidence, lookups and rankings over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import evidence, lookup, ranking, rules
from heddle.plans.catalog import query
from heddle.sources.tables import load


@query("select distinct o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def missing_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.missing(load(spark, d, "orders"), load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("select o_orderkey, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as used from orders")
def used_evidence_flag(spark: SparkSession, d: str) -> DataFrame:
    claims = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return evidence.mark_used(load(spark, d, "orders").select("o_orderkey"), claims, "o_orderkey")


@query("select distinct d.doc_id from documents d where d.doc_id in (select doc_id from labels where quality = 0)")
def low_confidence_claims(spark: SparkSession, d: str) -> DataFrame:
    return evidence.low_confidence(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id", F.col("quality") == 0)


def _corroborated(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem")
    return evidence.corroborated(rows, ["l_partkey"], "l_returnflag", "l_suppkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


CORROBORATED = """select l_partkey, l_returnflag, count(distinct l_suppkey) as sources, min(l_orderkey * 10 + l_linenumber) as first_seq
from lineitem group by l_partkey, l_returnflag having count(distinct l_suppkey) >= 2"""


@query(CORROBORATED)
def corroborated_values(spark: SparkSession, d: str) -> DataFrame:
    return _corroborated(spark, d)


@query(f"""select l_partkey, l_returnflag, sources, first_seq from (
  select *, row_number() over (partition by l_partkey order by sources desc, first_seq, l_returnflag) as r from ({CORROBORATED})) where r = 1""")
def corroboration_winner(spark: SparkSession, d: str) -> DataFrame:
    return evidence.winner(_corroborated(spark, d), ["l_partkey"], "l_returnflag")


@query("""select user_id, event_id, event_type, previous from (
  select *, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) where previous <> event_type""")
def evidence_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return evidence.conflicts(rows, ["user_id"], "event_type", ["ts", "event_id"]).drop("ts")


@query("""select user_id, event_type, event_id, value from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1""")
def latest_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.latest(load(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("""with p as (select * from (values (0, 'A', 'one.example'), (1, 'A', 'one.example'), (2, 'B', 'one.example'), (3, 'B', 'one.example')) t(provider_id, tier, domain)),
r as (select s_suppkey, n_regionkey as provider_id, 'https://' || case when s_nationkey % 2 = 0 then 'www.one.example' else 'other.test' end || '/x' as url from supplier join nation on s_nationkey = n_nationkey),
h as (select *, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) as host from r)
select s_suppkey, tier, case when tier is null then 'unknown_provider' when host <> domain and not ends_with(host, '.' || domain) then 'domain_not_allowed' end as reason from h left join p using (provider_id)""")
def provider_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").join(F.broadcast(load(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    host = F.when(F.col("s_nationkey") % 2 == 0, "www.one.example").otherwise("other.test")
    rows = rows.select("s_suppkey", F.col("n_regionkey").alias("provider_id"), F.concat(F.lit("https://"), host, F.lit("/x")).alias("url"))
    providers = spark.createDataFrame([(0, "A", ["one.example"]), (1, "A", ["one.example"]), (2, "B", ["one.example"]), (3, "B", ["one.example"])], "provider_id int, tier string, domains array<string>")
    return evidence.check_providers(rows, providers).select("s_suppkey", "tier", "reason")


@query("select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as claim_ids from orders group by o_custkey")
def claim_ids(spark: SparkSession, d: str) -> DataFrame:
    return evidence.claim_ids(load(spark, d, "orders").select("o_custkey", F.array("o_orderpriority").alias("ids")), "o_custkey", "ids")


@query("""select distinct o.o_orderkey from orders o left join (select l_orderkey, min(case when l_linenumber > 5 then '' else l_returnflag end) as original from lineitem group by l_orderkey) l
on o.o_orderkey = l.l_orderkey where coalesce(trim(l.original), '') = ''""")
def missing_originals(spark: SparkSession, d: str) -> DataFrame:
    original = F.min(F.when(F.col("l_linenumber") > 5, "").otherwise(F.col("l_returnflag")))
    ledger = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(original.alias("original"))
    return evidence.missing_originals(load(spark, d, "orders"), ledger, "o_orderkey", F.col("original"))


SCHEDULE = """with s as (select o_orderkey as match_id, least(o_custkey % 40, (o_custkey // 40) % 40) as lo, greatest(o_custkey % 40, (o_custkey // 40) % 40) as hi, cast(o_orderdate as date) as day from orders),
q as (select n as asked_id, least(n % 40, (n * 7) % 40) as lo, greatest(n % 40, (n * 7) % 40) as hi, case when n % 3 = 0 then null else date '1996-01-01' + cast(n * 5 % 365 as integer) end as day from range(200) r(n))"""


@query(f"""{SCHEDULE} select asked_id, match_id from (select asked_id, match_id, row_number() over (partition by asked_id order by coalesce(s.day = q.day, false) desc, s.day desc, match_id desc) as r
from q join s using (lo, hi) where q.day is null or abs(date_diff('day', q.day, s.day)) <= 1) where r = 1""")
def schedule_match(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("o_custkey") % 40, F.floor(F.col("o_custkey") / 40) % 40
    table = load(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), *lookup.pair_key(a, b), F.col("o_orderdate").cast("date").alias("day"))
    n = F.col("id")
    day = F.when(n % 3 != 0, F.date_add(F.lit("1996-01-01").cast("date"), (n * 5 % 365).cast("int")))
    asked = spark.range(200).select(n.alias("asked_id"), *lookup.pair_key(n % 40, n * 7 % 40), day.alias("day"))
    return lookup.scheduled(asked, table, "asked_id", "match_id")


@query("""with e as (select s_suppkey, s_name, s_nationkey, s_suppkey % 4 as k from supplier)
select s_suppkey, case when k in (0, 1) then n_name else 'old venue' end as venue, case when k in (0, 1) then 'd' || n_nationkey else 'old day' end as day,
 case when k in (0, 2) then case when k = 0 then 'S' || n_regionkey else case when s_suppkey % 8 = 2 then '' else 'Nieznany' end end else 'Final' end as stage
from e join nation on s_nationkey = n_nationkey""")
def schedule_enrich(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    rows = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    stage = F.when(k == 0, "").when(k == 2, F.when(F.col("s_suppkey") % 8 == 2, "").otherwise("Nieznany")).otherwise("Final")
    facts = rows.select("s_suppkey", F.lit("old venue").alias("venue"), F.lit("old day").alias("day"), stage.alias("stage"))
    nation = load(spark, d, "nation")
    table = rows.where(k < 2).join(F.broadcast(nation), rows.s_nationkey == nation.n_nationkey).select("s_suppkey", F.col("n_name").alias("venue"), F.concat(F.lit("d"), "n_nationkey").alias("day"), F.concat(F.lit("S"), "n_regionkey").alias("stage"))
    return lookup.enrich(facts, table, "s_suppkey")


@query("""with s as (select s_suppkey as slide_id, s_nationkey as claim_id, case when s_suppkey % 2 = 0 then 'As FRANCE and ' || s_name || ' say' else 'nothing' end as headline from supplier),
q as (select n_nationkey as quote_id, n_nationkey + 20 as claim_id, lower(n_name) as outlet from nation)
select slide_id, coalesce(any_value(c.quote_id), min(o.quote_id)) as quote_id from s left join q c on c.claim_id = s.claim_id
left join q o on list_contains(string_split_regex(lower(s.headline), '[^a-z0-9]+'), o.outlet) group by slide_id""")
def slide_quotes(spark: SparkSession, d: str) -> DataFrame:
    headline = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("As FRANCE and "), "s_name", F.lit(" say"))).otherwise("nothing")
    slides = load(spark, d, "supplier").select(F.col("s_suppkey").alias("slide_id"), F.col("s_nationkey").alias("claim_id"), headline.alias("headline"))
    quotes = load(spark, d, "nation").select(F.col("n_nationkey").alias("quote_id"), (F.col("n_nationkey") + 20).alias("claim_id"), F.lower("n_name").alias("outlet"))
    return lookup.quote_for_slide(slides, quotes)


@query("""with e as (select l_orderkey, l_linenumber as line, l_suppkey as s, l_partkey as p, unnest([l_suppkey + 1000000, l_suppkey, l_partkey % 100]) as id, unnest([0, 1, 2]) as spot from lineitem)
select l_orderkey, arg_min(s_name, (line, s, p, spot)) as outlet from e join supplier on s_suppkey = id group by l_orderkey""")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    """Every order, by the ids of all its rows in the order of line, supplier and part."""
    ids = F.array(F.col("l_suppkey") + 1_000_000, "l_suppkey", F.col("l_partkey") % 100)
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", ids.alias("ids"))
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    dim = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("outlet"))
    return lookup.attribution(rows.select("l_orderkey", F.flatten("lines.ids").alias("ids")), "ids", dim, "l_orderkey")


@query("""select c.c_custkey, coalesce(r.o_orderstatus, 'NO RUN') as o_orderstatus from customer c left join (
 select o_custkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end desc, o_orderkey desc) as r from orders) where r = 1) r on r.o_custkey = c.c_custkey""")
def roadmap(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    runs = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderkey")
    return lookup.best_status(load(spark, d, "customer"), runs, "c_custkey", rank, "o_orderkey", "o_orderstatus", "NO RUN")


TEMPLATES = ["{team} {opponent} reaction", "{team} press", "{opponent} defeat", "world cup {team}", "{team} press"]


@query("""with t as (select n_nationkey as team_id, [lower(n_name), 'team ' || n_nationkey, lower(n_name)] as variants, 'rival' || n_regionkey as opponent from nation),
e as (select team_id, opponent, unnest(variants) as v, unnest([0, 1, 2]) as i from t),
f as (select team_id, i * 5 + j as spot, replace(replace(tpl, '{team}', v), '{opponent}', opponent) as query
 from e, (values (0, '{team} {opponent} reaction'), (1, '{team} press'), (2, '{opponent} defeat'), (3, 'world cup {team}'), (4, '{team} press')) x(j, tpl)),
g as (select team_id, query, min(spot) as spot from f group by all)
select team_id, position, query from (select team_id, query, row_number() over (partition by team_id order by spot) - 1 as position from g) where position < 8""")
def query_templates(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower("n_name")
    teams = load(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"), F.array(name, F.concat(F.lit("team "), "n_nationkey"), name).alias("variants"), F.concat(F.lit("rival"), "n_regionkey").alias("opponent"))
    return lookup.expand_templates(teams, TEMPLATES).withColumn("position", F.col("position").cast("long"))


@query("select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all having count(*) > 1")
def catalog_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return rules.duplicates(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""select lang, source, doc_id, n_chars, rank from (
 select *, row_number() over (partition by lang, source order by n_chars desc, doc_id) as rank from documents) where rank <= 2""")
def panel_top2(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("lang", "source", "doc_id", "n_chars")
    return ranking.top_per(rows, ["lang", "source"], [F.col("n_chars").desc(), F.col("doc_id")], 2)


@query("""select source, doc_id, thin, rank from (select source, doc_id, case when length(text) < 900 then 1 else 0 end as thin,
 row_number() over (partition by source order by case when length(text) < 900 then 1 else 0 end, doc_id) as rank from documents) where rank <= 2""")
def thin_full_split(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("source", "doc_id", "text")
    return ranking.full_first(rows, "source", F.col("text"), "doc_id").select("source", "doc_id", "thin", "rank")


@query("""select source, doc_id, row_number() over (partition by source order by coalesce(quality = 0, false)::int, doc_id) as place from documents left join labels using (doc_id)""")
def demote_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id", "left").select("source", "doc_id", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("bad"))
    return ranking.demoted(rows, "source", F.col("bad"), "doc_id").select("source", "doc_id", "place")


@query("""with b as (select user_id, event_id, event_type = 'error' as op from events),
c as (select *, bool_or(op) over (partition by user_id) as any_op, row_number() over (partition by user_id, op order by event_id) as nth from b)
select user_id, event_id, row_number() over (partition by user_id order by case when not any_op then 0 when not op and nth = 1 then 0 when op then 1 else 2 end, event_id) as place from c""")
def opinion_interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select("user_id", "event_id", "event_type")
    return ranking.opinions_first(rows, "user_id", F.col("event_type") == "error", "event_id").select("user_id", "event_id", "place")


@query("""with f as (select doc_id, regexp_replace(trim(lower(string_split(text, chr(10))[1])), '\\s+', ' ', 'g') as title from documents where text is not null)
select min(doc_id) as doc_id, title from f where length(title) >= 12 group by title""")
def title_dedup(spark: SparkSession, d: str) -> DataFrame:
    title = ranking.title_key(F.element_at(F.split("text", "\n"), 1))
    rows = load(spark, d, "documents").select("doc_id", title.alias("title")).where("title is not null")
    return ranking.first_of(rows, ["title"], ["doc_id"])


@query("""with u as (select c_custkey as k, c_nationkey as a, c_nationkey + 100 as b from customer)
select k, concat_ws(',', a, b, 7) as joined, (select string_agg(x, ',') from (select unnest([a, 7, 3]) as x intersect select unnest([7, 3]) order by 1)) as common,
 case when a in (7, 3) then null else cast(a as varchar) end as rest from u""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("c_nationkey")
    first, second = F.array(a, F.lit(7), F.lit(3)), F.array(F.lit(7), F.lit(3))
    union = F.array_distinct(F.concat(F.array(a), F.array(a + 100), F.array(F.lit(7))))
    union = F.when(a == 7, F.array(a, a + 100, F.lit(7))).otherwise(union)
    rest = F.array_join(F.array_except(F.array(a), second), ",")
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(union, ",").alias("joined"), F.array_join(F.array_sort(F.array_intersect(first, second)), ",").alias("common"), F.when(rest != "", rest).alias("rest"))


@query("""with m as (select n_nationkey as key, n_name as value, 1 as priority from nation union all select n_nationkey, lower(n_name), 2 from nation where n_regionkey = 1 union all select 1000 + r_regionkey, r_name, 2 from region)
select key, arg_max(value, priority) as value from m group by key""")
def dict_merge(spark: SparkSession, d: str) -> DataFrame:
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    left = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), F.lit(1).alias("priority"))
    right = nation.where("n_regionkey = 1").select("n_nationkey", F.lower("n_name"), F.lit(2)).unionAll(region.select(F.col("r_regionkey") + 1000, "r_name", F.lit(2)))
    return evidence.latest(left.unionAll(right), ["key"], ["priority"], ["value"])
