"""Search hits composed from orders: the tables have no press URLs, so keys pick sites, sections,
dates, slugs and titles from lists. The same lists make the DataFrame and the SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import fixed
from heddle.sources.tables import load

SITES = ["www.harbour-gazette.example", "kickoff.example", "m.daily-lantern.example", "sportwetten.example", "resultater.fjord.example", "ledger.example"]
SECTIONS = ["sport", "world", "deportes", "economia", "video", "futbol/tardes", "tag", "nacionales/futbol"]
SLUGS = [
    "match-report-from-the-harbour", "first-take-by-our-own-desk", "press-review-of-monday", "world-ranking-has-moved", "ten-memes-of-the-night", "jordanian-olive-harvest", "how-they-beat-jordan-by-the-sea",
    "argentina-sank-jordan-late", "live-stream-of-the-regatta", "recap-2-1-under-rain", "friday-round-up", "brief", "league-results-standings", "opinion-on-the-new-roof",
]
TITLES = ["Jordan and Argentina meet", "Harvest prices today", "Crónica del viernes: Jordan 2-1", "Four voices on it", "Kommentar am Montag"]
#: The match that the hits are compared with.
DAY, SCORE = "2022-06-12", "2-1"
#: Stems that no text of a draft may have.
BANNED = ("idiot", "worthl", "scum", "the")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """(hit_id, url, title, published): published is null, early or late."""
    k = F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))
    day = F.date_format(F.add_months("o_orderdate", 300), "yyyy/MM/dd")
    compact = F.date_format(F.add_months("o_orderdate", 300), "yyyyMMdd")
    slug = F.concat(pick(SLUGS, k), F.when(k % 4 == 1, F.concat(F.lit("-"), compact)).otherwise(""))
    tail: Column = F.when(k % 6 == 0, F.concat(F.lit("/"), (k + 100000).cast("string"))).when(k % 6 == 1, F.concat(F.lit("-"), (k % 500).cast("string"))).when(k % 6 == 2, ".html").otherwise("")
    query = F.when(k % 10 == 3, "?page=2").when(k % 10 == 4, "?page=").otherwise("")
    url = F.concat(F.lit("https://"), pick(SITES, F.floor(k / 3)), F.lit("/"), pick(SECTIONS, F.floor(k / 2)), F.when(k % 3 == 0, F.concat(F.lit("/"), day)).otherwise(""), F.lit("/"), slug, tail, query)
    title = F.concat(pick(TITLES, F.floor(k / 7)), F.when(k % 3 != 0, F.concat(F.lit(", part "), (k % 41).cast("string"), F.lit(" of it"))).otherwise(""))
    published = F.when(k % 5 == 0, F.date_format(F.add_months("o_orderdate", 300), "yyyy-MM-dd"))
    hit = F.struct(k.alias("hit_id"), url.alias("url"), title.alias("title"), published.alias("published"))
    return load(spark, d, "orders").select(F.inline(F.array(hit)))  # composed once, however often it is asked for


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_words(words: tuple[str, ...]) -> str:
    return _list(list(words))


HITS = f"""hits as (select o_orderkey as hit_id, 'https://' || {_list(SITES)}[1 + o_orderkey // 3 % {len(SITES)}] || '/' || {_list(SECTIONS)}[1 + o_orderkey // 2 % {len(SECTIONS)}]
 || case when o_orderkey % 3 = 0 then strftime(o_orderdate + interval 300 month, '/%Y/%m/%d') else '' end || '/' || {_list(SLUGS)}[1 + o_orderkey % {len(SLUGS)}]
 || case when o_orderkey % 4 = 1 then strftime(o_orderdate + interval 300 month, '-%Y%m%d') else '' end
 || case o_orderkey % 6 when 0 then '/' || (o_orderkey + 100000) when 1 then '-' || (o_orderkey % 500) when 2 then '.html' else '' end
 || case o_orderkey % 10 when 3 then '?page=2' when 4 then '?page=' else '' end as url,
 {_list(TITLES)}[1 + o_orderkey // 7 % {len(TITLES)}] || case when o_orderkey % 3 <> 0 then ', part ' || (o_orderkey % 41) || ' of it' else '' end as title,
 case when o_orderkey % 5 = 0 then strftime(o_orderdate + interval 300 month, '%Y-%m-%d') end as published from orders)"""

#: Host, path and its segments of a URL; folded blobs of the two in either order.
PARTS = r"""parts as (select *, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as query,
 list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as segs,
 translate(lower(strip_accents(url || ' ' || title)), '-_', '  ') as blob from hits)"""


def sql_any_word(column: str, words: tuple[str, ...]) -> str:
    from heddle.functions.text import any_word_plain

    return f"regexp_matches({column}, '{any_word_plain(words)}')"


#: The latest date that a URL has.
URL_DATE = r"""list_max(list_concat(
 list_transform(regexp_extract_all(url, '/20\d{2}[/-](?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])(?:[^0-9]|$)'), lambda x: substr(x, 2, 4) || '-' || substr(x, 7, 2) || '-' || substr(x, 10, 2)),
 list_transform(regexp_extract_all(url, '(?:^|[^0-9])(20\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))(?:[^0-9]|$)', 1), lambda x: substr(x, 1, 4) || '-' || substr(x, 5, 2) || '-' || substr(x, 7, 2)),
 list_transform(regexp_extract_all(url, '/(2[4-9](?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))\d{3}(?:/|$|\?)', 1), lambda x: '20' || substr(x, 1, 2) || '-' || substr(x, 3, 2) || '-' || substr(x, 5, 2))))"""
#: The URL without its dates, folded with the title before it.
SLUG = r"""translate(lower(strip_accents(title || ' ' || regexp_replace(regexp_replace(regexp_replace(url, '/20\d{2}[/-](0[1-9]|1[0-2])[/-](0[1-9]|[12]\d|3[01])', ' ', 'g'), '20\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])', ' ', 'g'), '/2[4-9](0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}(/|$|\?)', ' ', 'g'))), '-_', '  ')"""


def sql_scores(column: str) -> str:
    """The list of "a-b" of a text's sentences that are not on a partial score. At most one stands in each."""
    from heddle.functions.text import quoted

    partial = "|".join(map(quoted, (*fixed.HALF_TIME, *fixed.SHOOT_OUT, *fixed.EXTRA_TIME))).replace("'", "''")
    found = r"(^|[^0-9-])([0-9]{1,2})\s*[-:]\s*([0-9]{1,2})([^0-9-]|$)"
    folded = "replace(translate(lower(strip_accents(s)), 'łø', 'lo'), 'ß', 'ss')"
    number = lambda k: f"regexp_extract(s, '{found}', {k})"
    score = f"case when try_cast({number(2)} as integer) <= {fixed.MAX_SCORE} and try_cast({number(3)} as integer) <= {fixed.MAX_SCORE} then {number(2)} || '-' || {number(3)} end"
    return f"list_distinct(list_filter(list_transform(list_filter(string_split_regex({column}, '[.;!?\n]'), lambda s: not regexp_matches({folded}, '{partial}')), lambda s: {score}), lambda x: x is not null))"
