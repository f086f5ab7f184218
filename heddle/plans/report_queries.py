"""Queries on validation, status and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import fixed
from heddle.operators import lookup, reports, rules
from heddle.plans.catalog import query
from heddle.sources.tables import load

#: Conversations play packages, their turns slides.
PACKAGES = """pk as (select conv_id, count(*) as n, count(distinct role) as roles, arg_min(role, turn) as first_role, arg_max(role, turn) as last_role, max(length(text)) as longest, count(*) filter (trim(text) = '') as blank, bool_or(contains(text, 'idiot')) as banned from conversations group by conv_id)"""
CHECKS = """ck as (select conv_id, unnest(['carousel_size', 'cta_present', 'fair_use', 'hook_first', 'no_banned_phrases']) as check_name,
 unnest([n between 2 and 7, last_role = 'assistant', longest <= 420, first_role = 'user', not banned]) as good, unnest([cast(n as varchar), last_role, cast(longest as varchar), first_role, '']) as details from pk)"""


def _packages(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.max(F.length("text")).alias("longest"), F.bool_or(F.contains("text", F.lit("idiot"))).alias("banned"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return rules.checks(_packages(spark, d), "conv_id", {
        "carousel_size": (c("n").between(2, 7), c("n")), "cta_present": (c("last_role") == "assistant", c("last_role")), "fair_use": (c("longest") <= fixed.FAIR_USE, c("longest")),
        "hook_first": (c("first_role") == "user", c("first_role")), "no_banned_phrases": (~c("banned"), F.lit("")),
    })


@query(f"with {PACKAGES}, {CHECKS} select conv_id, check_name, case when good then 'pass' else 'fail' end as result, details from ck")
def turn_checks(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).withColumnRenamed("check", "check_name")


FACTS = """fc as (select l_orderkey as k, max(l_linenumber) as n, count(distinct l_linenumber) < count(*) as conflict, bool_or(l_quantity < 2) as low, bool_or(l_linenumber > 6) as missing from lineitem group by l_orderkey)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.count_distinct("l_linenumber") < F.count("*")).alias("conflict"), F.bool_or(F.col("l_quantity") < 2).alias("low"), F.bool_or(F.col("l_linenumber") > 6).alias("missing"))
    return rules.checks(rows, "k", {"missing_evidence": (~F.col("missing"), F.lit("")), "source_conflicts": (~F.col("conflict"), F.lit("")), "low_confidence_claims": (~F.col("low"), F.lit(""))})


BLOCKING = "concat_ws(',', case when low then 'low_confidence_claims' end, case when missing then 'missing_evidence' end, case when conflict then 'source_conflicts' end)"


@query(f"with {FACTS} select k, {BLOCKING} as blocking, case when low or missing or conflict then 'needs_human_review' else 'pass' end as status from fc")
def fact_check(spark: SparkSession, d: str) -> DataFrame:
    return rules.report(_facts(spark, d), "k")


@query(f"""with {PACKAGES}, {CHECKS}, {FACTS}, q as (select conv_id, bool_and(good) as good from ck group by conv_id)
select conv_id, case when q.good and not (low or missing or conflict) and conv_id % 5 <> 0 then 'ready' else 'needs_human_review' end as status from q left join fc on k = conv_id""")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    quality = rules.report(_quality(spark, d), "conv_id").select("conv_id", F.col("status").alias("quality"))
    facts = rules.report(_facts(spark, d), "k").select(F.col("k").alias("conv_id"), F.col("status").alias("facts"))
    joined = quality.join(facts, "conv_id", "left")
    return joined.select("conv_id", rules.final_status(F.col("facts"), F.col("quality"), F.col("conv_id") % 5 == 0).alias("status"))


@query("select doc_id, case when toxic = 0 then 40 else 0 end + case when quality = 1 then 40 else 0 end + case when doc_id % 11 >= 7 then 20 else 0 end as score from labels")
def leaderboard_score(spark: SparkSession, d: str) -> DataFrame:
    word = lambda c: F.when(c, "pass").otherwise("fail")
    return load(spark, d, "labels").select("doc_id", rules.leaderboard(word(F.col("toxic") == 0), word(F.col("quality") == 1), F.col("doc_id") % 11).alias("score"))


@query("select count(*) as total, count(*) filter (quality = 1 and toxic = 0) as passed, count(*) - count(*) filter (quality = 1 and toxic = 0) as failed, round(count(*) filter (quality = 1 and toxic = 0) / count(*), 3) as pass_rate from labels")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return rules.summary(load(spark, d, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0))


@query(f"""with {PACKAGES}, {CHECKS}, x as (select conv_id, unnest(['carousel_size', 'hook_first', 'no_such_check']) as check_name, unnest(['pass', case when conv_id % 2 = 0 then 'pass' else 'fail' end, 'pass']) as want from pk)
select x.conv_id, count(*) filter (c.good is null) as missing, count(*) filter (case when c.good then 'pass' else 'fail' end <> want and c.good is not null) as wrong from x left join ck c using (conv_id, check_name) group by x.conv_id""")
def scenario_assertions(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*(F.struct(F.lit(n).alias("check"), r.alias("result")) for n, r in (("carousel_size", F.lit("pass")), ("hook_first", F.when(F.col("conv_id") % 2 == 0, "pass").otherwise("fail")), ("no_such_check", F.lit("pass")))))
    expected = _packages(spark, d).select("conv_id", F.inline(wanted))
    return rules.scenario(expected, _quality(spark, d), "conv_id")


SIDES = """sides as (select n_nationkey as k, n_regionkey, 30 + (n_nationkey * 7) % 41 as home_possession, 70 - (n_nationkey * 7) % 41 as away_possession, case when n_nationkey % 6 = 5 then null else n_nationkey % 17 end as home_shots, n_nationkey % 5 as away_shots, n_nationkey % 3 = 0 as penalties from nation)"""


def _sides(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return load(spark, d, "nation").select(k.alias("k"), (30 + (k * 7) % 41).alias("home_possession"), (70 - (k * 7) % 41).alias("away_possession"), F.when(k % 6 != 5, k % 17).alias("home_shots"), (k % 5).alias("away_shots"), (k % 3 == 0).alias("penalties"))


@query(f"""with {SIDES} select k, 'penalty_final' as kind, 'high' as confidence from sides where penalties union all select k, 'possession_vs_finish', 'high' from sides where abs(home_possession - away_possession) >= 18
union all select k, 'shot_volume', 'medium' from sides where abs(home_shots - away_shots) >= 6""")
def metric_insights(spark: SparkSession, d: str) -> DataFrame:
    return reports.insights(_sides(spark, d), "k")


@query(f"with {SIDES} select k, case when penalties then 'possession_trap' else 'three_numbers' end as archetype, case when penalties then 10 else 5 end as total from sides")
def angle_select(spark: SparkSession, d: str) -> DataFrame:
    return reports.angle(_sides(spark, d), "k")


@query("""with f as (select s_nationkey, 'u' || s_suppkey % 4 as url, min(s_suppkey) as s_suppkey from supplier group by all)
select n_nationkey, string_agg('- ' || s_name || ' (' || n_name || '): ' || url, chr(10) order by s_suppkey) as sources from f join supplier using (s_suppkey) join nation on n_nationkey = f.s_nationkey group by n_nationkey""")
def caption_sources(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    rows = load(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == nation.n_nationkey).withColumn("url", F.concat(F.lit("u"), F.col("s_suppkey") % 4))
    line = F.concat(F.lit("- "), "s_name", F.lit(" ("), "n_name", F.lit("): "), "url")
    return reports.sources(rows, "n_nationkey", "s_suppkey", "url", line, "sources")


@query("""with n as (select n_nationkey, [n_name, 'Team ' || n_name, n_name, 'x'] as names from nation), t as (select n_nationkey, list_concat(['#heddle', '#press'], list_transform(list_filter(list_transform(names, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: length(x) between 2 and 30), lambda x: '#' || x)) as tags from n),
e as (select n_nationkey, tag, min(i) as i from (select n_nationkey, unnest(tags) as tag, unnest(range(len(tags))) as i from t) group by all) select n_nationkey, string_agg(tag, ' ' order by i) as tags from e group by n_nationkey""")
def hashtags(spark: SparkSession, d: str) -> DataFrame:
    names = F.array("n_name", F.concat(F.lit("Team "), "n_name"), "n_name", F.lit("x"))
    return load(spark, d, "nation").select("n_nationkey", F.array_join(reports.hashtags(["#heddle", "#press"], names), " ").alias("tags"))


@query("""with p as (select conv_id, 0 as bucket, 0 as seq, 'title' as role from conversations group by conv_id union all select conv_id, 1, turn, role from conversations union all select conv_id, 2, 0, 'sources' from conversations group by conv_id)
select conv_id, role, row_number() over (partition by conv_id order by bucket, seq) as slide from p""")
def slide_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations")
    ids = rows.select("conv_id").distinct()
    title = ids.select("conv_id", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("seq"), F.lit("title").alias("role"))
    quotes = rows.select("conv_id", F.lit(1), "turn", "role")
    last = ids.select("conv_id", F.lit(2), F.lit(0).cast("long"), F.lit("sources"))
    return reports.numbered(title.unionAll(quotes).unionAll(last), "conv_id", "bucket", "seq").select("conv_id", "role", "slide")


PALETTES = [("mexico city", "green"), ("york", "blue"), ("united", "red")]


@query("""select s_suppkey, case when contains(v, 'mexico city') then 'green' when contains(v, 'york') then 'blue' when contains(v, 'united') then 'red' else 'default' end as palette from (
 select s_suppkey, lower(n_name || case s_suppkey % 3 when 0 then ', México City' when 1 then ', New York' else '' end) as w, replace(lower(n_name || case s_suppkey % 3 when 0 then ', México City' when 1 then ', New York' else '' end), 'é', 'e') as v from supplier join nation on s_nationkey = n_nationkey)""")
def venue_palette(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    k = F.col("s_suppkey") % 3
    rows = load(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == nation.n_nationkey)
    venue = F.concat("n_name", F.when(k == 0, ", México City").when(k == 1, ", New York").otherwise(""))
    return rows.select("s_suppkey", lookup.first_alias(venue, PALETTES, "default").alias("palette"))


@query(r"""select conv_id, turn, case when length(text) - length(replace(replace(replace(text, '.', ''), '!', ''), '?', '')) < 3 then 'too_few_sentences' when length(text) > 1400 then 'too_long' when regexp_matches(text, '[0-9]') then 'unknown_digits' when contains(text, 'idiot') then 'banned' else 'ok' end as verdict from conversations""")
def summary_validator(spark: SparkSession, d: str) -> DataFrame:
    marks = F.length("text") - F.length(F.translate("text", ".!?", ""))
    ladder = [(marks >= 3, "too_few_sentences"), (F.length("text") <= fixed.SUMMARY_CHARS, "too_long"), (~F.col("text").rlike("[0-9]"), "unknown_digits"), (~F.contains("text", F.lit("idiot")), "banned")]
    return load(spark, d, "conversations").select("conv_id", "turn", rules.first_failure(ladder).alias("verdict"))
