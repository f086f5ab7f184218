"""Queries of the judges: documents play packages, their lines slides, the first three also segments. All that a
judge looks at is taken from the texts, in the query and in its SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import fixed
from heddle.operators import judges, rules
from heddle.plans.catalog import query
from heddle.plans.hits import BANNED
from heddle.sources.sinks import materialised
from heddle.sources.tables import load

HEADLINE, HOOK_LINE, CTA_LINE = 40, 60, 160

_banned = "[" + ", ".join(
    f"case when regexp_matches(folded, '(^|[^a-z0-9]){p}[a-z]{{0,4}}([^a-z0-9]|$)') then '{p}' end" for p in BANNED
) + "]"
HITS = f"array_to_string(list_sort(list_filter({_banned}, lambda x: x is not null)), ', ')"

#: Lines and what a package has of them.
PACKAGES = rf"""
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i
  from documents where text is not null
), slides as (
  select doc_id, i, line, case when length(line) < {HOOK_LINE} then 'hook' when length(line) < {CTA_LINE} then 'cta' else 'fact' end as role,
         substr(line, 1, {HEADLINE}) as headline, substr(line, {HEADLINE + 1}) as body
  from lines
), whole as (
  select doc_id, count(*) as n, arg_min(line, i) as first_line, arg_max(line, i) as last_line,
         arg_min(role, i) as first_role, arg_max(role, i) as last_role, arg_min(headline, i) as first_headline,
         string_agg(line, ' ' order by i) filter (i < 3) as segment_text,
         string_agg(headline, ' ' order by i) || ' ' || string_agg(body, ' ' order by i) as slide_text
  from slides group by doc_id
), packages as (
  select w.*, regexp_extract(first_line, '^([^.!?]*)', 1) as hook, case when right(last_line, 1) in ('.', '!', '?') then right(last_line, 40) else '' end as cta,
         regexp_extract(text, '([0-9]+)', 1) as main_number, regexp_extract(text, '(@[a-z0-9.]+|://[^ ]+)', 1) as source_note,
         case when length(first_line) <= 120 then '0-3s' else '0-9s' end as first_range, lower(text) as low
  from whole w join documents using (doc_id)
), judged as (
  select *, lower(strip_accents(hook || ' ' || cta || ' ' || first_line || ' ' || source_note || ' ' || segment_text || ' ' || slide_text)) as folded
  from packages
)"""


def _slides(docs: DataFrame) -> DataFrame:
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
    size = F.length("line")
    role = F.when(size < HOOK_LINE, "hook").when(size < CTA_LINE, "cta").otherwise("fact")
    headline, body = F.substring("line", 1, HEADLINE), F.substring(F.col("line"), HEADLINE + 1, 1 << 30)
    return lines.select("doc_id", "position", "line", role.alias("role"), headline.alias("headline"), body.alias("body"))


def _packages(docs: DataFrame) -> DataFrame:
    lines = F.split("text", "\n", -1)
    first, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
    part = lambda value, pattern: F.regexp_extract(value, pattern, 1)
    return docs.where("text is not null").select(
        "doc_id",
        part(first, "^([^.!?]*)").alias("thesis"),
        part(first, "^([^.!?]*)").alias("hook"),
        F.when(F.right(last, F.lit(1)).isin(".", "!", "?"), F.right(last, F.lit(40))).otherwise("").alias("cta"),
        first.alias("caption"),
        part(F.col("text"), "(@[a-z0-9.]+|://[^ ]+)").alias("source_note"),
        part(F.col("text"), "([0-9]+)").alias("main_number_id"),
        F.col("text").alias("safe_assets"),
    )


def _shape(docs: DataFrame) -> DataFrame:
    slides = _slides(docs)
    time_range = F.when(F.length("line") <= 120, "0-3s").otherwise("0-9s").alias("time_range")
    segments = slides.where("position < 3").select("doc_id", "position", time_range, F.col("line").alias("text"))
    return judges.copy_shape(_packages(docs), segments, slides, "doc_id")


QUALITY = f"""{PACKAGES}, quality as (
  select doc_id, unnest(['single_angle', 'hook_first_three_seconds', 'carousel_has_5_to_7_slides', 'slide_one_is_tension', 'main_number_present',
                         'cta_present', 'source_note_present', 'no_broadcast_clips', 'no_banned_phrases']) as check_name,
         unnest([hook <> '', hook <> '' and starts_with(first_range, '0-3'), n between 5 and 7, first_role = 'hook' and not contains(substr(first_headline, 1, 3), '?'),
                 main_number <> '', cta <> '' and last_role = 'cta', source_note <> '', not contains(low, 'fragment transmisji'), {HITS} = '']) as good,
         unnest([hook, '', cast(n as varchar), '', '', '', '', 'visual brief lists safe asset types only', {HITS}]) as details
  from judged
  union all select doc_id, 'package_exists', false, '' from documents where text is null
)"""


@query(f"with {QUALITY} select doc_id, check_name, case when good then 'pass' else 'fail' end as result, details from quality")
def quality_judge(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return judges.quality_checks(docs, _shape(docs), "doc_id", BANNED).withColumnRenamed("check", "check_name")


#: Claims are the numbers in a text; evidence those of documents in the same language that are labelled good.
CLAIMS = """claims as (select distinct doc_id, unnest(regexp_extract_all(text, '[0-9]+')) as id from documents),
evidence as (select distinct d.doc_id, t.id from documents d join (
  select distinct d.lang, unnest(regexp_extract_all(d.text, '[0-9]+')) as id from documents d join labels l using (doc_id) where l.quality = 1) t using (lang)
  join claims c on c.doc_id = d.doc_id and c.id = t.id)"""


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, "documents")
    numbers = F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"))).alias("id")
    claims = docs.select("doc_id", numbers).distinct()
    good = load(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    known = docs.join(good, "doc_id", "left_semi").select("lang", numbers).distinct()
    evidence = claims.join(docs.select("doc_id", "lang").distinct(), "doc_id").join(known, ["lang", "id"]).select("doc_id", "id")
    return claims, evidence


@query(f"""with {PACKAGES}, {CLAIMS}, unknown as (select distinct doc_id from claims c anti join evidence e on c.doc_id = e.doc_id and c.id = e.id)
select doc_id, case when hook = '' then 'empty_hook' when not starts_with(first_range, '0-3') then 'late_hook' when n not between 5 and 7 then 'slide_count'
  when first_role <> 'hook' then 'first_slide' when last_role <> 'cta' then 'last_slide' when cta = '' then 'empty_cta' when source_note = '' then 'no_source_note'
  when doc_id in (select doc_id from unknown) then 'unknown_claims' when {HITS} <> '' then 'banned' else 'ok' end as verdict from judged""")
def copy_structure(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = _claims(spark, d)
    return judges.copy_verdicts(_shape(load(spark, d, "documents")), claims, evidence, "doc_id", BANNED)


#: Conversations play media packages: turns are quotes, roles countries, an order of the same number the match.
MEDIA = rf"""
quotes as (
  select conv_id, role as country, turn, regexp_extract(text, '^([A-Za-z]+)', 1) as outlet, regexp_extract(text, '([a-z]+[.])$', 1) as url, text,
         case when turn % 2 = 1 then regexp_extract(text, '^([^.]*[.])', 1) || ' ' || (length(text) % 4) || '-' || (turn % 4) end as summary
  from conversations
), matches as (select distinct conv_id, conv_id % 4 || '-' || conv_id % 3 as score from conversations
), countries as (
  select conv_id, country, count(*) as n, case when max(length(text)) > 300 then arg_max(text, turn) end as mood from quotes group by all
), media as (
  select m.conv_id, m.score, q.*, c.* exclude (conv_id) from matches m join (
    select conv_id, bool_and(outlet <> '' and url <> '') as named, string_agg(case when length(text) > {fixed.FAIR_USE} then cast(turn as varchar) end, ', ' order by cast(turn as varchar)) as long,
           arg_min(country, turn) as first_country, arg_max(country, turn) as last_country,
           lower(strip_accents(string_agg(text, ' ' order by turn))) as folded from quotes group by conv_id) q using (conv_id)
  join (select conv_id, count(*) as n_panels, string_agg(country || ':' || n, ', ' order by country || ':' || n) as per_panel,
               string_agg(case when mood is not null and n < 2 then country end, ', ' order by country) as bad_mood from countries group by conv_id) c using (conv_id)
), repeated as (
  select q.conv_id, string_agg(cast(turn as varchar), ', ' order by cast(turn as varchar)) as ids from quotes q join matches m using (conv_id)
  where summary is not null and (ends_with(summary, ' ' || score) or ends_with(summary, ' ' || split_part(score, '-', 2) || '-' || split_part(score, '-', 1))) group by q.conv_id
)"""


def _media(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    rows = load(spark, d, "conversations")
    part = lambda pattern: F.regexp_extract("text", pattern, 1)
    number: Column = F.concat(F.lit(" "), F.length("text") % 4, F.lit("-"), F.col("turn") % 4)
    quotes = rows.select(
        "conv_id", F.col("role").alias("country"), F.col("turn").alias("id"), F.col("turn").alias("position"), part("^([A-Za-z]+)").alias("outlet"),
        part("([a-z]+[.])$").alias("url"), F.col("text").alias("translation"), F.when(F.col("turn") % 2 == 1, F.concat(part("^([^.]*[.])"), number)).alias("summary"),
    )
    score = F.concat_ws("-", F.col("conv_id") % 4, F.col("conv_id") % 3).alias("score")
    blank = [F.lit("").alias(c) for c in ("headline", "body", "caption", "source_note")]
    packages = rows.select("conv_id").distinct().select("conv_id", score, *blank)
    mood = F.when(F.max(F.length("translation")) > 300, F.max_by("translation", "position"))
    panels = quotes.groupBy("conv_id", "country").agg(F.count("*").alias("source_count"), mood.alias("mood"))
    role = F.when(F.col("role") == "user", "title").otherwise("sources")
    slides = rows.select("conv_id", F.col("turn").alias("position"), role.alias("role"), F.lit("").alias("headline"), F.lit("").alias("body"))
    return packages, panels, quotes, slides


@query(f"""with {MEDIA}, checked as (select media.conv_id,
  unnest(['both_countries_present', 'every_quote_has_outlet_and_url', 'quote_within_fair_use_length', 'mood_requires_two_sources', 'score_only_on_title_slide',
          'title_slide_present', 'sources_slide_present', 'no_banned_phrases']) as check_name,
  unnest([n_panels >= 2, named, long is null, bad_mood is null, ids is null, first_country = 'user', last_country <> 'user', {HITS} = '']) as good,
  unnest([per_panel, '', coalesce(long, ''), coalesce(bad_mood, ''), coalesce(ids, ''), '', '', {HITS}]) as details
  from media left join repeated using (conv_id))
select conv_id, check_name, case when good then 'pass' else 'fail' end as result, details from checked""")
def media_quality_judge(spark: SparkSession, d: str) -> DataFrame:
    packages, panels, quotes, slides = _media(spark, d)
    return judges.media_quality_checks(packages, packages, panels, quotes, slides, "conv_id", BANNED).withColumnRenamed("check", "check_name")


@query(f"""with {MEDIA}, originals as (select conv_id, turn, case when contains(text, chr(10)) then text else '' end as original from conversations where length(text) > 40),
missing as (select q.conv_id, string_agg(cast(q.turn as varchar), ', ' order by cast(q.turn as varchar)) as ids from quotes q anti join originals o on o.conv_id = q.conv_id and o.turn = q.turn group by q.conv_id),
bare as (select q.conv_id, string_agg(cast(q.turn as varchar), ', ' order by cast(q.turn as varchar)) as ids from quotes q left join originals o on o.conv_id = q.conv_id and o.turn = q.turn where coalesce(original, '') = '' group by q.conv_id),
odd as (select conv_id, string_agg(distinct cast(turn as varchar), ', ' order by cast(turn as varchar)) as ids from conversations where regexp_matches(text, '(^|[^A-Za-z])[Tt]he ') and length(text) > 900 group by conv_id),
found as (select conv_id, list_sort(list_distinct(list((length(text) % 4) || '-' || (turn % 4)))) as s from quotes where summary is not null group by conv_id),
apart as (select f.conv_id, array_to_string(s, ', ') as said from found f join matches m using (conv_id) where not list_contains(s, score) and not list_contains(s, split_part(score, '-', 2) || '-' || split_part(score, '-', 1)))
select m.conv_id, unnest(['all_claims_have_evidence', 'no_source_conflicts', 'original_retained_in_evidence', 'score_consistent_with_media']) as check_name,
 unnest([case when missing.ids is null then 'pass' else 'fail' end, case when odd.ids is null then 'pass' else 'fail' end, case when bare.ids is null then 'pass' else 'fail' end, case when said is null then 'pass' else 'fail' end]) as result,
 unnest([coalesce(missing.ids, ''), coalesce(odd.ids, ''), coalesce(bare.ids, ''), coalesce(said, '')]) as details
from matches m left join missing using (conv_id) left join bare using (conv_id) left join odd using (conv_id) left join apart using (conv_id)""")
def media_fact_judge(spark: SparkSession, d: str) -> DataFrame:
    """Turns of more than 40 characters are evidence, those of several lines have an original; long ones with an
    article are in conflict."""
    packages, _, quotes, _ = _media(spark, d)
    rows = load(spark, d, "conversations").withColumn("id", F.col("turn"))
    original = F.when(F.contains("text", F.lit("\n")), F.col("text")).otherwise("")
    evidence = rows.where(F.length("text") > 40).select("conv_id", "id", original.alias("original"))
    conflicts = rows.where(F.col("text").rlike("(^|[^A-Za-z])[Tt]he ") & (F.length("text") > 900))
    quoted = quotes.select("conv_id", "id", F.col("summary").alias("text"))
    found = judges.media_fact_checks(packages, packages, quoted, quotes, evidence, conflicts, "conv_id")
    return found.withColumnRenamed("check", "check_name")


@query(f"""with {QUALITY}, rolled as (select doc_id, bool_and(good) as good, list(check_name) filter (good) as passed, list(check_name) filter (not good) as failed from quality group by doc_id),
runs as (select q.doc_id, case when q.good then 'ready' else 'needs_human_review' end as status, q.good, passed, failed, coalesce(l.toxic = 0, false) as facts, lower(j.folded) as copy
  from rolled q left join labels l using (doc_id) left join judged j using (doc_id)),
x as (select doc_id, list_concat(
  case when status = 'needs_human_review' then [] else ['status'] end,
  list_transform(list_filter(['cta_present', 'single_angle'], lambda c: not list_contains(coalesce(passed, []), c)), lambda c: 'not_passed:' || c),
  list_transform(list_filter(['carousel_has_5_to_7_slides'], lambda c: not list_contains(coalesce(failed, []), c)), lambda c: 'not_failed:' || c),
  list_transform(list_filter(['main_number_present'], lambda c: not list_contains(coalesce(failed, []), c)), lambda c: 'not_blocking:' || c),
  list_transform(list_filter(['copyright', 'http'], lambda c: contains(coalesce(copy, ''), c)), lambda c: 'forbidden:' || c)) as f,
  case when facts then 40 else 0 end + case when good then 40 else 0 end as score from runs)
select doc_id, len(f) = 0 as passed, array_to_string(f, ',') as failures, score from x""")
def scenario_results(spark: SparkSession, d: str) -> DataFrame:
    """What a scenario expects of every document, against the judge's checks of it."""
    docs = load(spark, d, "documents")
    shape = _shape(docs)
    # asked for twice, and each check looks at whole texts: they are judged once, and only the results kept
    checks = materialised(judges.quality_checks(docs, shape, "doc_id", BANNED).select("doc_id", "check", "result"))
    rolled = checks.groupBy("doc_id").agg(F.bool_and(F.col("result") == "pass").alias("good"))
    labels = load(spark, d, "labels").select("doc_id", "toxic")
    word = lambda c: F.when(c, "pass").otherwise("fail")
    rows = rolled.join(labels, "doc_id", "left").join(shape.select("doc_id", "copy"), "doc_id", "left")
    rows = rows.withColumns({"facts": word(F.coalesce(F.col("toxic") == 0, F.lit(False))), "quality": word(F.col("good"))})
    runs = rows.select("doc_id", F.when(F.col("good"), rules.READY).otherwise(rules.REVIEW).alias("status"), "facts", "quality", F.lit(0).alias("angle_total"), "copy")
    some = lambda *names: F.array(*map(F.lit, names))
    scenarios = docs.select("doc_id").distinct().select(
        "doc_id", F.lit(rules.REVIEW).alias("expected_status"), some("single_angle", "cta_present").alias("must_pass"),
        some("carousel_has_5_to_7_slides").alias("must_fail"), some("main_number_present").alias("expected_blocking"), some("http", "copyright").alias("forbidden"),
    )
    return judges.scenario_results(scenarios, runs, checks, "doc_id")
