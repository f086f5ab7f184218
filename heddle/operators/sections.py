"""Links of outlets' section pages that are on a match: which sections are asked, which links are kept, what each section is told to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import urls
from heddle.functions.text import fold_jvm, let, match_blob
from heddle.operators import health

MAX_SECTIONS = 3


def names_to_find(aliases: Column) -> Column:
    """Aliases of three characters or more, folded."""
    return F.transform(F.filter(aliases, lambda a: F.length(a) >= 3), fold_jvm)


def reaction_words(templates: Column, event: Column, aliases: Column) -> Column:
    """The words of the query templates with four Latin letters or more, and the parts of the event's local name, but no own alias; folded."""
    bare = lambda t: F.replace(F.replace(t, F.lit("{team}"), F.lit(" ")), F.lit("{opponent}"), F.lit(" "))
    words = F.flatten(F.transform(templates, lambda t: F.regexp_extract_all(bare(t), F.lit("[A-Za-z\u00C0-\u017F]{4,}"), F.lit(0))))
    parts = F.filter(F.split(fold_jvm(F.coalesce(event, F.lit(""))), r"[\s\-_]+"), lambda p: F.length(p) >= 2)
    return F.array_except(F.array_union(F.transform(words, fold_jvm), parts), F.transform(aliases, fold_jvm))


def on_match(blob: Column, opponent: Column, own: Column, words: Column) -> Column:
    """The opponent is named, or the own team is and a word of reaction stands by itself."""
    named = lambda names: F.exists(names, lambda n: F.contains(blob, n))
    alone = lambda w: F.rlike(blob, F.concat(F.lit("(?<![a-z0-9])\\Q"), w, F.lit("\\E(?![a-z0-9])")))
    return F.coalesce(named(opponent) | (named(own) & F.exists(words, alone)), F.lit(False))


def section_hits(sections: DataFrame, links: DataFrame, profiles: DataFrame, limit: int = MAX_SECTIONS) -> tuple[DataFrame, DataFrame]:
    """(hits, probes) of the sections that are asked.

    ``sections`` (country, section, idx, dead, last_probe, domains) are put in ``health.probe_order`` and the first ``limit`` of a country are asked.
    ``links`` (section, position, href, anchor) are what their pages have. ``profiles`` (country, opponent, own, words) say what is looked for, as
    arrays of folded names; a country without opponent names has no hits.

    hits (country, place, section, position, url, title, key): links of the outlet's domains that look like articles and are on the match, of
    each article key the first by place and position. A link that is not on the match does not take its key.
    probes (country, section, place, article_links, links_found, outcome): articles are counted before the match is looked for."""
    asked = health.probe_order(sections, "country", limit).where(F.col("place") <= limit).select("country", "section", "place", "domains")
    href = F.col("href")
    met = asked.join(links, "section").select("country", "section", "place", "position", "href", "anchor", "domains", F.explode(F.array(urls.parsed(href))).alias("at"))
    article = urls.domain_allowed(href, F.col("domains"), F.col("at")) & urls.is_article(href, F.col("at"))
    found = met.where(article).join(profiles, "country", "left")
    blob = match_blob(F.concat_ws(" ", "anchor", "href"))
    fits = (F.size("opponent") > 0) & let(blob, lambda b: on_match(b, F.col("opponent"), F.col("own"), F.col("words")))
    keyed = found.select("country", "section", "place", "position", F.col("href").alias("url"), F.col("anchor").alias("title"), urls.article_key(href, F.col("at")).alias("key"), F.coalesce(fits, F.lit(False)).alias("fits"))
    first = F.min_by(F.struct("place", "section", "position", "url", "title", "key"), F.struct("place", "position")).alias("h")
    hits = keyed.where("fits").groupBy("country", F.col("key").alias("__key")).agg(first).select("country", "h.*")
    counts = keyed.groupBy("country", "section").agg(F.count("*").alias("article_links"))
    new = hits.groupBy("country", "section").agg(F.count("*").alias("links_found"))
    probes = asked.drop("domains").join(counts, ["country", "section"], "left").join(new, ["country", "section"], "left")
    links_of = F.coalesce("article_links", F.lit(0))
    outcome = F.when(links_of > 0, "links").otherwise("no_links").alias("outcome")
    return hits, probes.select("country", "section", "place", links_of.alias("article_links"), F.coalesce("links_found", F.lit(0)).alias("links_found"), outcome)
