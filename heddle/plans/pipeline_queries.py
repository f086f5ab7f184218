"""Queries on drafts, fact providers, rescues, resolution, dimensions and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import fold
from heddle.operators import collect, lookup, pipelines, ranking, validators
from heddle.plans.catalog import query
from heddle.sources.sinks import shared_folder
from heddle.sources.tables import load
from heddle.streaming import cache
from heddle.streaming import health as stream
from heddle.streaming.stateful import drained, keyed_state


@query("""with d as (select l_partkey % 500 as k, l_suppkey, l_orderkey * 10 + l_linenumber as seq, (l_orderkey % 3) || '-' || (l_partkey % 2) as score from lineitem),
c as (select k, score, count(distinct l_suppkey) as sources, min(seq) as first_seq from d group by all having count(distinct l_suppkey) >= 2)
select k, score, sources from (select *, row_number() over (partition by k order by sources desc, first_seq, score) as r from c) where r = 1""")
def corroborated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts name the teams in either order and turn the score with them."""
    a, b = (F.col("l_orderkey") % 3).cast("string"), (F.col("l_partkey") % 2).cast("string")
    odd = F.col("l_linenumber") % 2 == 1
    drafts = load(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("k"), "l_suppkey", F.when(odd, "Beta").otherwise("Alpha").alias("home"), F.when(odd, "Alpha").otherwise("Beta").alias("away"), F.when(odd, F.concat_ws("-", b, a)).otherwise(F.concat_ws("-", a, b)).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return pipelines.corroborated_facts(drafts, "k", "l_suppkey", "home", "away", "score", "seq")


@query("""with c as (select o_custkey as k, case o_orderstatus when 'F' then 0 when 'P' then 1 else 2 end as priority, o_orderkey from orders)
select k, priority, o_orderkey from (select *, row_number() over (partition by k order by priority, o_orderkey) as r from c) where r = 1""")
def facts_chain(spark: SparkSession, d: str) -> DataFrame:
    """Official facts before corroborated ones before fixtures."""
    priority = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), priority.alias("priority"), "o_orderkey")
    return ranking.first_of(rows, ["k"], ["priority", "o_orderkey"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def recurate_pool(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.recurate(load(spark, d, "documents").select("doc_id"), load(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("""select conv_id, string_agg(case when contains(lower(text), lower(role)) then 'RPA:' else role || ' (RPA):' end || chr(10) || text, chr(10) || chr(10) order by turn) as post from conversations group by conv_id""")
def x_posts(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.x_post(load(spark, d, "conversations"), "conv_id", "turn", F.col("role"), F.lit("RPA"), F.col("text"))


@query("""with w as (select c_custkey, c_name, c_nationkey from customer), f as (select c_custkey, case when c_custkey % 3 = 0 then upper(n_name) when c_custkey % 3 = 1 then 'Nowhere' else lower(n_name) end as asked, n_name from w join nation on c_nationkey = n_nationkey)
select c_custkey, case when c_custkey % 3 = 1 then asked else n_name end as canonical from f""")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    k = F.col("c_custkey") % 3
    rows = load(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.when(k == 0, F.upper("n_name")).when(k == 1, "Nowhere").otherwise(F.lower("n_name")).alias("asked"))
    dim = nation.select(fold(F.col("n_name")).alias("alias"), F.col("n_name").alias("canonical"))
    return lookup.match_name(rows, dim, "c_custkey", "asked")


@query("""select p.conv_id, case when n_panels = 0 then 'insufficient_evidence' when n_panels = 1 then 'needs_human_review' end as status from (select conv_id, count(distinct role) - 1 as n_panels from conversations group by conv_id) p""")
def media_availability(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").groupBy("conv_id").agg((F.count_distinct("role") - 1).alias("panels"))
    return rows.select("conv_id", pipelines.available(F.col("panels")).alias("status"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = load(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


HEALTH_SQL = """with ev as (select user_id as key, event_id, ts, event_type as outcome, strftime(ts, '%Y-%m-%d') as day from events), daily as (select * from (select *, row_number() over (partition by key, outcome, day order by ts, event_id) as r from ev) where r = 1)
select key, event_id, outcome, day, age from (select *, row_number() over (partition by key order by ts desc, event_id desc) as age from daily) where age <= 20"""


@query("""select event_id as seq, coalesce(ts < last_ts + interval 3600 second, false) as hit from (
 select event_id, ts, last_value(case when event_type <> 'error' then ts end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_ts from events)""")
def stream_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups that arrive in three parts, in the order of time; the query stops after each and goes on from its state."""
    folder = shared_folder(spark, "cache")
    events = load(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("cacheable"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    a, b = (F.lit(first + (last - first) * k / 3) for k in (1, 2)) if first else (F.col("ts"), F.col("ts"))
    for part in (F.col("ts") < a, (F.col("ts") >= a) & (F.col("ts") < b), F.col("ts") >= b):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        drained(cache.hits(arriving, ["user_id"], "ts", "event_id", 3600, "cacheable"), folder)
    return spark.read.parquet(f"{folder}/out")


@query(HEALTH_SQL)
def stream_health(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream through keyed state, to the same windows as the batch query's."""
    rows = _event_stream(spark, d).withColumn("outcome", F.col("event_type")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    folder = shared_folder(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    with keyed_state(spark):
        started = stream.windows(rows, "user_id").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    last = out.groupBy("key").agg(F.max("batch").alias("batch"))
    return out.join(last, ["key", "batch"]).select("key", "event_id", "outcome", "day", "age")


@query("select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n from events group by all")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """An extension: daily counts with a watermark."""
    folder = shared_folder(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    started = stream.counts(_event_stream(spark, d), "ts", "event_type").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy(F.col("start").cast("date").alias("day"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("""select l_returnflag, l_linestatus, count(*) as n, sum(cast(l_quantity as bigint)) as quantity from lineitem group by cube (l_returnflag, l_linestatus)""")
def grouping_cube(spark: SparkSession, d: str) -> DataFrame:
    """An extension: grouping sets."""
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("""select user_id, min(event_id) as first_event, count(*) as n from (select *, sum(case when ts >= prev + interval 6 hour or prev is null then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)) group by user_id, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """An extension: sessions that end after six hours without an event."""
    rows = load(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = rows.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))
    return found.select("user_id", "first_event", "n")


#: Orders as hits of a customer's queries, asked in the order of their priority; sites, texts and drafts follow from price and day.
COLLECTED = """h as (select o_custkey as request, cast(o_orderpriority[1:1] as integer) as query, o_orderkey as seq, o_totalprice as price,
 'https://' || ['a.example', 'www.b.example', 'c.test'][1 + o_orderkey % 3] || '/' || case when o_totalprice > 60000 then 'sport/late-goal-decides-it-' || o_orderkey else 'tag' end as url,
 case when o_orderstatus = 'F' then 'They won ' || o_custkey % 4 || '-' || o_orderkey % 3 || ' there.' when o_orderstatus = 'O' then 'No numbers here' end as page,
 repeat('Words of the index. ', cast(floor(o_totalprice / 3000) as integer)) as indexed, 'T' || o_custkey % 9 as home, 'T' || o_orderkey % 5 as away, strftime(o_orderdate, '%Y-%m-%d') as day,
 row_number() over (partition by o_custkey order by o_orderkey) as nth from orders),
wanted as (select *, 'T' || request % 9 as want_a, 'T' || (request + 1) % 5 as want_b, case when request % 7 = 0 then [] else ['a.example', 'b.example'] end as domains from h)"""


def _collected(spark: SparkSession, d: str) -> DataFrame:
    k, order, price, status = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    site = F.element_at(F.array(F.lit("a.example"), F.lit("www.b.example"), F.lit("c.test")), (1 + order % 3).cast("int"))
    path = F.when(price > 60_000, F.concat(F.lit("sport/late-goal-decides-it-"), order)).otherwise("tag")
    page = F.when(status == "F", F.concat(F.lit("They won "), k % 4, F.lit("-"), order % 3, F.lit(" there."))).when(status == "O", "No numbers here")
    team = lambda n: F.concat(F.lit("T"), n)
    return load(spark, d, "orders").select(
        k.alias("request"), F.substring("o_orderpriority", 1, 1).cast("int").alias("query"), order.alias("seq"), F.concat(F.lit("https://"), site, F.lit("/"), path).alias("url"), page.alias("page"),
        F.repeat(F.lit("Words of the index. "), F.floor(price / 3000).cast("int")).alias("indexed"), team(k % 9).alias("home"), team(order % 5).alias("away"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a.example"), F.lit("b.example"))).alias("domains"), price.alias("price"),
    )


FACTS = f"""{COLLECTED}, good as (select * from wanted where len(domains) > 0 and price > 60000 and seq % 3 < 2),
asked as (select g.* from good g join (select request, min(query) as query from good group by request) m using (request, query)),
read as (select *, case when page is not null and regexp_matches(page, '[0-9]-[0-9]') then page end as text, case when list_sort([home, away]) <> list_sort([want_a, want_b]) then 'teams' end as why from asked)"""


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("request")
    text = pipelines.facts_text(F.col("page"), F.lit(None).cast("string"), F.lit(""), F.lit(""))
    why = validators.draft_mismatch(F.col("home"), F.col("away"), F.col("day"), F.concat(F.lit("T"), k % 9), F.concat(F.lit("T"), (k + 1) % 5), F.lit(None).cast("string"))
    return collect.facts(_collected(spark, d), "request", "query", "seq", "domains", text, why)


@query(f"with {FACTS} select request, seq, query, text from (select *, row_number() over (partition by request order by seq) as r from read where text is not null and why is null) where r = 1")
def collected_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the first query with articles of the provider's domains."""
    return _facts(spark, d)[0].select("request", "seq", "query", "text")


@query(f"""with {FACTS} select request, count(*) as hits, count(*) filter (text is null) as without_text, coalesce(string_agg(distinct case when text is not null then why end, ','), '') as reasons
from read group by request having count(*) filter (text is not null and why is null) = 0""")
def facts_notes(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d)[1]


@query(f"""with {COLLECTED}, b as (select *, case when price > 60000 and seq % 3 < 2 then 'outlet' end as provider, case when seq % 5 > 0 then left(indexed, 20000) end as ix, case when seq % 5 > 0 and indexed <> '' and seq % 2 = 0 then null else page end as pg from h),
t as (select *, case when coalesce(length(nullif(ix, '')), -1) > coalesce(length(pg), -1) then ix else pg end as text, coalesce(page, '') = '' or seq % 4 > 0 as played, price < 300000 as quoted from b),
k as (select *, case when coalesce(length(text), 0) < 900 then 1 else 0 end as thin from t where provider is not null),
taken as (select * from (select *, row_number() over (partition by request order by thin, seq) as r from k where played and quoted) where r <= 2),
saved as (select *, row_number() over (partition by request order by seq) as r from k where not played and request not in (select request from taken) and regexp_matches(coalesce(text, ''), '^They won (2-1|1-2) there'))
select request, seq, thin = 1 as thin, false as rescued, r as rank from taken union all select request, seq, thin = 1, true, 1 from saved where r = 1""")
def collected_articles(spark: SparkSession, d: str) -> DataFrame:
    """Two articles of each customer, full ones first; where there are none, one that has the score 2-1."""
    seq = F.col("seq")
    hits = _collected(spark, d).withColumn("provider_id", F.when((F.col("price") > 60_000) & (seq % 3 < 2), "outlet"))
    text = collect.body(F.col("page"), F.when(seq % 5 > 0, F.col("indexed")), seq % 2 == 0)
    played = (F.coalesce("page", F.lit("")) == "") | (seq % 4 > 0)
    return collect.articles(hits.withColumn("text", text), "request", "seq", "text", played, F.col("price") < 300_000, F.lit("2"), F.lit("1"))
