"""Queries on URLs, hits and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import fixed, urls
from heddle.functions.text import among, fold_python, match_blob, words_found
from heddle.operators import lookup, pools, ranking, sections
from heddle.plans.catalog import query
from heddle.plans.hits import DAY, HITS, PARTS, SCORE, SLUG, URL_DATE, hits, sql_any_word, sql_words
from heddle.sources.tables import load, page_links as links_of, page_text as text_of

WHITELIST = ["example.org", "example.com"]
HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


@query(f"select page_id, {HOST} as host, regexp_matches({HOST}, '(^|[.])example[.](org|com)$') as allowed, true as unlisted from pages")
def domain_whitelist(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    none = F.array().cast("array<string>")
    return load(spark, d, "pages").select("page_id", urls.host(url).alias("host"), urls.domain_allowed(url, F.array(*map(F.lit, WHITELIST))).alias("allowed"), urls.domain_allowed(url, none).alias("unlisted"))


OUTLETS = [("one", "B", "example.com"), ("two", "A", "thther.example.org"), ("three", "A", "example.org"), ("four", "C", "blog.ththan.example.net"), ("five", "A", "example.net"), ("six", "B", "example.net")]


@query(f"""with o as (select * from (values {", ".join(map(str, OUTLETS))}) t(provider_id, tier, domain)), p as (select page_id, {HOST} as host from pages)
select page_id, provider_id from (select page_id, provider_id, row_number() over (partition by page_id order by tier, provider_id) as r from p join o on host = domain or ends_with(host, '.' || domain)) where r = 1""")
def url_to_outlet(spark: SparkSession, d: str) -> DataFrame:
    outlets = spark.createDataFrame(OUTLETS, "provider_id string, tier string, domain string")
    return lookup.outlet_for_url(load(spark, d, "pages").select("page_id", "url"), outlets, "page_id")


ARTICLE = f"""coalesce(not (
 list_has_any(string_split(host, '.'), {sql_words(fixed.BETTING_LABELS + fixed.SCOREBOARD_LABELS)}) or regexp_matches(query, '(^|&)page=[^&]') or length(trim(path, '/')) < 6
 or list_has_any(list_transform(segs, lambda s: lower(s)), {sql_words(fixed.MEDIA_SEGMENTS)})
 or len(list_intersect(string_split(lower(segs[-1]), '-'), {sql_words(fixed.LIST_WORDS)})) >= 2
 or len(list_filter(segs, lambda s: regexp_matches(lower(s), '^(video-|galeria-|gallery-)'))) > 0 or regexp_matches(segs[-1], '^(19|20)[0-9][0-9]$')
 or len(list_filter({sql_words(fixed.PREMATCH_MARKERS + fixed.DIGEST_MARKERS + fixed.INTERACTIVE_MARKERS)}, lambda m: contains(segs[-1], m))) > 0
) and case when len(segs) = 1 then length(segs[-1]) - length(replace(segs[-1], '-', '')) >= 2 or regexp_matches(segs[-1], '[0-9]')
 else contains(segs[-1], '-') or regexp_matches(segs[-1], '[0-9]') or (length(segs[-2]) - length(replace(segs[-2], '-', '')) >= 2 and regexp_matches(segs[-2], '[0-9]')) end, false)"""


@query(f"with {HITS}, {PARTS} select hit_id, {ARTICLE} as article from parts")
def article_urls(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("hit_id", urls.is_article(F.col("url")).alias("article"))


@query(f"with hits as (select page_id, url, '' as title from pages), {PARTS} select page_id, {ARTICLE} as article from parts")
def article_pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", urls.is_article(F.col("url")).alias("article"))


KEY = r"""regexp_replace(host, '^www[.]', '') || case when regexp_matches(path, '[0-9]+[.][0-9]{6,}') then '/id/' || regexp_extract(path, '[0-9]+[.][0-9]{6,}')
 when len(list_filter(cores, lambda c: regexp_matches(c, '^[0-9]{6,}$'))) > 0 then '/id/' || list_filter(cores, lambda c: regexp_matches(c, '^[0-9]{6,}$'))[-1]
 when spot > 0 then '/' || array_to_string(list_concat(segs[1:spot - 1], [cores[spot]]), '/') else '/' || array_to_string(segs, '/') end"""
KEYED = rf"""cored as (select *, list_transform(segs, lambda s: regexp_replace(s, '[.][^.]*$', '')) as cores from parts),
 spotted as (select *, coalesce(list_max(list_transform(range(1, len(cores) + 1), lambda k: case when regexp_matches(cores[k], '^[0-9]{{4,}}$') and not regexp_matches(cores[k], '^(19|20)[0-9][0-9]$') then k end)), 0) as spot from cored)"""


@query(f"with {HITS}, {PARTS}, {KEYED} select hit_id, {KEY} as key from spotted")
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("hit_id", urls.article_key(F.col("url")).alias("key"))


@query(f"with hits as (select page_id, url, '' as title from pages), {PARTS}, {KEYED}, k as (select page_id, {KEY} as key from spotted) select min(page_id) as page_id, key from k group by key")
def canonical_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "pages").select("page_id", urls.article_key(F.col("url")).alias("key"))
    return ranking.first_of(rows, ["key"], ["page_id"])


@query(rf"""with {HITS}, x as (select *, {URL_DATE} as url_date from hits)
select hit_id, url_date, coalesce(try_cast(url_date as date) < date '{DAY}' - 2, false) as too_old, coalesce(try_cast(url_date as date) < date '{DAY}' - 1, false) as prematch, coalesce(published < '{DAY}', false) as published_before from x""")
def url_dates(spark: SparkSession, d: str) -> DataFrame:
    url, day = F.col("url"), F.lit(DAY)
    return hits(spark, d).select("hit_id", urls.url_date(url).alias("url_date"), urls.too_old(url, day).alias("too_old"), urls.is_prematch(url, day).alias("prematch"), urls.published_before(F.col("published"), day).alias("published_before"))


@query(f"""with {HITS}, {PARTS} select hit_id, {sql_any_word("blob", fixed.OPINION)} as opinion, {sql_any_word("blob", fixed.ROUNDUP)} as roundup, {sql_any_word("blob", fixed.RANKING)} as ranking, {sql_any_word("blob", fixed.SOCIAL)} as social,
 {sql_any_word("blob", fixed.ROUNDUP + fixed.RANKING + fixed.SOCIAL)} as non_reaction, {sql_any_word("blob", fixed.REPORT)} as report,
 not list_has_any(list_transform(segs, lambda s: lower(s)), {sql_words(fixed.SPORTS_SEGMENTS)}) and list_has_any(list_transform(segs, lambda s: lower(s)), {sql_words(fixed.OTHER_SEGMENTS)}) as other_section,
 {sql_any_word("blob", tuple(f"{v} jordan" for v in fixed.TRIBUTE_VERBS))} as tribute from parts""")
def hit_flags(spark: SparkSession, d: str) -> DataFrame:
    """All word lists are looked for in one pass over each folded text."""
    url, title = F.col("url"), F.col("title")
    lists = {"opinion": fixed.OPINION, "roundup": fixed.ROUNDUP, "ranking": fixed.RANKING, "social": fixed.SOCIAL, "report": fixed.REPORT, "tribute": urls.tribute_phrases(("Jordan", "JO"))}
    lists["non_reaction"] = fixed.ROUNDUP + fixed.RANKING + fixed.SOCIAL
    every = tuple(t for words in lists.values() for t in words)
    blob = match_blob(F.concat_ws(" ", url, title))
    rows = hits(spark, d).select("hit_id", "url", F.explode(F.array(words_found(blob, every))).alias("found"))
    return rows.select("hit_id", *(among(F.col("found"), words, every).alias(n) for n, words in lists.items()), urls.is_other_section(url).alias("other_section"))


@query(rf"""with {HITS}, s as (select hit_id, {SLUG} as slug from hits) select hit_id, regexp_matches(slug, '(^|[^0-9])[0-9]{{1,2}}\s*[-: ]\s*[0-9]{{1,2}}([^0-9]|$)') as has_score,
 regexp_matches(slug, '(^|[^0-9])(0?2\s*[-: ]\s*0?1|0?1\s*[-: ]\s*0?2)([^0-9]|$)') as final_score from s""")
def slug_scores(spark: SparkSession, d: str) -> DataFrame:
    url, title = F.col("url"), F.col("title")
    rows = hits(spark, d).withColumn("slug", urls.slug_blob(url, title))
    return rows.select("hit_id", urls.hints_score(url, title, F.col("slug")).alias("has_score"), urls.mentions_final_score(F.lit(SCORE), url, title, F.col("slug")).alias("final_score"))


CONTEXT = f"""(contains(blob, 'argentina') or {sql_any_word("blob", ("jordan",))} or not contains(blob, 'jordan') or {sql_any_word("blob", ("mundial", "world", "2026"))} or regexp_matches(blob, '(^|[^0-9])[0-9]{{1,2}}\\s*[-: ]\\s*[0-9]{{1,2}}([^0-9]|$)'))"""


@query(f"with {HITS}, {PARTS} select hit_id, {CONTEXT} as in_context from parts")
def match_context(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("hit_id", urls.has_match_context(F.col("url"), F.col("title"), ("Jordan", "JO"), ("Argentina",), ("mundial", "world")).alias("in_context"))


ALIASES = ("jordan", "argentina", "world")


SCORED = rf"""{HITS}, {PARTS}, {KEYED}, scored as (select hit_id, host, {ARTICLE} as article, {KEY} as key, contains(url, '/deportes/') as section, {CONTEXT} as in_context,
 case when length(trim(regexp_replace(lower(title), '\s+', ' ', 'g'))) >= 12 then trim(regexp_replace(lower(title), '\s+', ' ', 'g')) end as title_key,
 coalesce(try_cast({URL_DATE} as date) < date '{DAY}' - 2, false) as too_old, coalesce(published < '{DAY}', false) as published_before, coalesce(try_cast({URL_DATE} as date) < date '{DAY}' - 1, false) as prematch,
 {sql_any_word("blob", fixed.ROUNDUP + fixed.RANKING + fixed.SOCIAL)} as non_reaction, {sql_any_word("blob", fixed.ROUNDUP)} as roundup,
 not list_has_any(list_transform(segs, lambda s: lower(s)), {sql_words(fixed.SPORTS_SEGMENTS)}) and list_has_any(list_transform(segs, lambda s: lower(s)), {sql_words(fixed.OTHER_SEGMENTS)}) as other_section,
 regexp_matches({SLUG}, '(^|[^0-9])[0-9]{{1,2}}\s*[-: ]\s*[0-9]{{1,2}}([^0-9]|$)') as has_score,
 contains(blob, 'jordan')::int + contains(blob, 'argentina')::int + contains(blob, 'world')::int as relevance from spotted)"""
ALLOWED = ("harbour-gazette.example", "kickoff.example", "daily-lantern.example", "fjord.example")


@query(f"""with recursive {SCORED}, good as (
  select *, row_number() over (partition by host order by section desc, hit_id) as r from scored
  where not too_old and (section or (article and not published_before and in_context and regexp_matches(host, '(^|[.])({"|".join(x.replace(".", "[.]") for x in ALLOWED)})$')))
), walk as (
  select distinct host, cast(0 as bigint) as n, cast(0 as bigint) as r, cast([] as varchar[]) as keys, cast([] as varchar[]) as titles from good
  union all
  select w.host, w.n + 1, min(g.r), list_append(any_value(w.keys), arg_min(g.key, g.r)), list_append(any_value(w.titles), arg_min(coalesce(g.title_key, ''), g.r))
  from walk w join good g on g.host = w.host and g.r > w.r and (g.section or w.n < {pools.pool_cap()})
   and not list_contains(w.keys, g.key) and (g.title_key is null or not list_contains(w.titles, g.title_key)) group by w.host, w.n
), kept as (select g.* from walk w join good g on g.host = w.host and g.r = w.r)
select host, hit_id, key, rank from (select *, row_number() over (partition by host order by prematch, non_reaction, other_section, relevance desc, section desc, hit_id) as rank from kept) where rank <= {fixed.ARTICLES}""")
def pool_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The media pool of each site; its own section's links come before what searches find."""
    rows = hits(spark, d).withColumns({"host": urls.host(F.col("url")), "section": F.contains("url", F.lit("/deportes/"))})
    match = {"own": ("Jordan", "JO"), "opponent": ("Argentina",), "signals": ("mundial", "world")}
    return pools.collected(rows, "host", "hit_id", F.lit(DAY), F.array(*map(F.lit, ALLOWED)), **match, aliases=ALIASES)


@query(f"""with {SCORED} select host, hit_id, rank from (select *, row_number() over (partition by host order by not has_score, prematch, roundup, relevance desc, hit_id) as rank from scored
 where article and not too_old and not published_before) where rank <= 3""")
def facts_pool(spark: SparkSession, d: str) -> DataFrame:
    url, title, blob = F.col("url"), F.col("title"), F.col("blob")
    old = urls.too_old(url, F.lit(DAY)) | urls.published_before(F.col("published"), F.lit(DAY))
    rows = hits(spark, d).where(urls.is_article(url) & ~old)
    rows = rows.select("hit_id", "url", "title", F.explode(F.array(match_blob(F.concat_ws(" ", url, title)))).alias("blob"))
    rows = rows.select(
        "hit_id", urls.host(url).alias("host"), urls.hints_score(url, title).alias("has_score"), urls.is_prematch(url, F.lit(DAY)).alias("prematch"),
        urls.is_roundup(url, title, blob).alias("roundup"), ranking.relevance(blob, tuple(map(fold_python, ALIASES))).alias("relevance"),
    )
    return ranking.top_per(rows, ["host"], ranking.facts_order("hit_id"), fixed.FACT_ARTICLES).select("host", "hit_id", "rank")


@query(r"""with l as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1)) as href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 2)) as anchor,
 unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1)))) as spot from pages),
a as (select page_id, spot, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then href when starts_with(href, '/') then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href else '' end as href,
 substr(trim(regexp_replace(regexp_replace(anchor, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 200) as anchor from l)
select page_id, row_number() over (partition by page_id order by spot) - 1 as position, href, anchor from a where starts_with(href, 'http')""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return links_of(load(spark, d, "pages")).withColumn("position", F.col("position").cast("long"))


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", text_of(F.col("html")).alias("text"))


@query("""with e as (select event_id, event_type, cast(floor(value * 10) as bigint) % 12 as b from events), s as (select event_id, event_type, case b when 0 then 401 when 1 then 403 when 2 then 451 when 3 then 400 when 4 then 404 when 5 then 410 when 6 then 429 when 7 then 503 end as status from e)
select event_id, case when status in (401, 403, 451) then 'botblock' when status in (400, 404, 410) then 'stale_path' when status in (429, 503) then 'transient' when event_type = 'view' then 'empty' when event_type = 'click' then 'transient' else 'error' end as fetch,
 case event_type when 'error' then '432' when 'click' then 'transient' else 'error' end as search from s""")
def fetch_outcome_class(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.floor(F.col("value") * 10) % 12
    status = F.element_at(F.array(*map(F.lit, (401, 403, 451, 400, 404, 410, 429, 503, None, None, None, None))), (bucket + 1).cast("int"))
    message = F.when(F.col("event_type") == "view", "Pusta tresc").when(F.col("event_type") == "click", "read TimeOut").when(F.col("event_type") == "error", "HTTP 432").otherwise("odd")
    return load(spark, d, "events").select("event_id", urls.fetch_outcome(status, message).alias("fetch"), urls.search_outcome(message).alias("search"))


@query(f"""with {HITS}, {PARTS}, {KEYED}, s as (select hit_id, url, title, host, {ARTICLE} as article, {KEY} as key, contains(blob, 'argentina') or (contains(blob, 'jordan') and {sql_any_word("blob", ("mundial", "world"))}) as fits from spotted),
a as (select *, row_number() over (partition by host, key order by hit_id) as n from s where article)
select host, count(*) as article_links, count(*) filter (fits and n = 1) as matching, case when count(*) > 0 then 'links' else 'no_links' end as outcome from a group by host""")
def section_probe(spark: SparkSession, d: str) -> DataFrame:
    """Links of each section: articles, and the distinct ones that fit the match."""
    from heddle.functions.text import has_part, has_word

    blob = match_blob(F.concat_ws(" ", "url", "title"))
    fits = has_part(blob, ("argentina",)) | (has_part(blob, ("jordan",)) & has_word(blob, ("mundial", "world")))
    rows = hits(spark, d).select("hit_id", urls.host(F.col("url")).alias("host"), urls.article_key(F.col("url")).alias("key"), fits.alias("fits"), urls.is_article(F.col("url")).alias("article")).where("article")
    first = rows.groupBy("host", "key").agg(F.count("*").alias("n"), F.min_by("fits", "hit_id").alias("fits"))
    counted = first.groupBy("host").agg(F.sum("n").alias("article_links"), F.count_if("fits").alias("matching"))
    return counted.withColumn("outcome", F.when(F.col("article_links") > 0, "links").otherwise("no_links"))


#: Templates of queries and the event's name, whose words tell reactions.
TEMPLATES, EVENT = ["{team} {opponent} mundial regatta", "press late {team}"], "World Cup-2026"
REACTIONS = ("mundial", "regatta", "press", "late", "world", "cup", "2026")

SECTION_LINKS = f"""{HITS}, {PARTS}, {KEYED}, linked as (select hit_id, host, host || '/' || segs[1] as section, url, title, {ARTICLE} as article, {KEY} as key,
 contains(blob, 'argentina') or (contains(blob, 'jordan') and {sql_any_word("blob", REACTIONS)}) as fits from spotted),
asked as (select * from (select host, section, row_number() over (partition by host order by section) as place from (select distinct host, section from linked)) where place <= 3),
met as (select l.*, place from linked l join asked a on l.host = a.host and l.section = a.section where article and regexp_matches(l.host, '(^|[.])({"|".join(x.replace(".", "[.]") for x in ALLOWED)})$')),
first as (select * from (select *, row_number() over (partition by host, key order by place, hit_id) as n from met where fits) where n = 1)"""


def _sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    links = hits(spark, d).select(urls.host(F.col("url")).alias("host"), F.element_at(urls.segments(F.col("url")), 1).alias("name"), F.col("hit_id").alias("position"), F.col("url").alias("href"), F.col("title").alias("anchor"))
    links = links.select("host", F.concat_ws("/", "host", "name").alias("section"), "position", "href", "anchor")
    named = links.groupBy(F.col("host").alias("country"), "section").agg(F.lit(False).alias("dead"), F.lit(None).cast("string").alias("last_probe"))
    named = named.select("*", F.row_number().over(Window.partitionBy("country").orderBy("section")).alias("idx"), F.array(*map(F.lit, ALLOWED)).alias("domains"))
    words = sections.reaction_words(F.array(*map(F.lit, TEMPLATES)), F.lit(EVENT), F.array(F.lit("Jordan"), F.lit("JO")))
    names = lambda *x: sections.names_to_find(F.array(*map(F.lit, x)))
    profiles = named.select("country").distinct().select("country", names("Argentina", "AR").alias("opponent"), names("Jordan", "JO").alias("own"), words.alias("words"))
    return sections.section_hits(named, links.drop("host"), profiles)


@query(f"with {SECTION_LINKS} select host as country, section, place, hit_id as position, key from first")
def section_hits(spark: SparkSession, d: str) -> DataFrame:
    """Links of each site's first sections that are on the match, each article once."""
    return _sections(spark, d)[0].select("country", "section", "place", "position", "key")


@query(f"""with {SECTION_LINKS}, c as (select host, section, count(*) as article_links from met group by all), f as (select host, section, count(*) as links_found from first group by all)
select a.host as country, a.section, place, coalesce(article_links, 0) as article_links, coalesce(links_found, 0) as links_found, case when coalesce(article_links, 0) > 0 then 'links' else 'no_links' end as outcome
from asked a left join c using (host, section) left join f using (host, section)""")
def section_probes(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d)[1]
