"""The media pool: candidates of a pool in order of their source, filtered, without copies, capped, ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import fixed, urls
from heddle.functions.text import fold_python, match_blob
from heddle.operators import ranking


def pool_cap(articles: int = fixed.ARTICLES) -> int:
    return max(2 * articles, 6)


def parts(hits: DataFrame) -> DataFrame:
    """Hits (url, title, ...) with ``it``: what the rules below ask of a hit, computed once. That is the URL's parts (at), its date, and both
    texts folded (blob, and turned with the title first)."""
    # a line feed is in neither; folding leaves it
    folded = F.split(match_blob(F.concat_ws("\n", F.coalesce(F.translate("url", "\n", " "), F.lit("")), F.translate("title", "\n", " "))), "\n")
    first = F.struct(urls.parsed(F.col("url")).alias("at"), urls.url_date(F.col("url")).alias("date"), folded.alias("folded"))
    rows = hits.select("*", F.inline(F.array(first)))
    url = F.when(F.col("url").isNotNull(), F.col("folded")[0])
    title = F.when(F.col("title").isNotNull(), F.get("folded", F.lit(1)))
    it = F.struct("at", "date", F.concat_ws(" ", url, title).alias("blob"), F.concat_ws(" ", title, url).alias("turned"))
    return rows.select(*hits.columns, F.explode(F.array(it)).alias("it"))


def fits(hits: DataFrame, day: Column, domains: Column, own: tuple[str, ...], opponent: tuple[str, ...], signals: tuple[str, ...]) -> Column:
    """Whether a hit (url, title, published, section, it) may be in the pool: none is too old; one from a search
    is also an article of an allowed domain, not published before the day, and on the match."""
    url, it = F.col("url"), F.col("it")
    searched = (
        urls.domain_allowed(url, domains, it["at"])
        & urls.is_article(url, it["at"])
        & ~urls.published_before(F.col("published"), day)
        & urls.has_match_context(url, F.col("title"), own, opponent, signals, it["turned"])
    )
    return ~urls.too_old(url, day, it["date"]) & (F.col("section") | searched)


def with_order(rows: DataFrame, day: Column, aliases: tuple[str, ...]) -> DataFrame:
    """Rows (url, title, it) with what orders a pool."""
    url, title, it = F.col("url"), F.col("title"), F.col("it")
    return rows.withColumns({
        "prematch": urls.is_prematch(url, day, it["date"]),
        "non_reaction": urls.is_non_reaction(url, title, it["blob"]),
        "other_section": urls.is_other_section(url),
        "relevance": ranking.relevance(it["blob"], tuple(map(fold_python, aliases))),
    })


def collected(
    hits: DataFrame, pool: str, seq: str, day: Column, domains: Column, own: tuple[str, ...], opponent: tuple[str, ...], signals: tuple[str, ...],
    aliases: tuple[str, ...], articles: int = fixed.ARTICLES,
) -> DataFrame:
    """(pool, seq, key, rank): the best articles of each pool. Hits (pool, seq, url, title, published, section) are
    taken sections first, each in the order of seq; copies by key or title are left out, and hits from searches
    end when the pool is full. What is shuffled of all hits is keys and titles; flags are computed for those
    that are left."""
    whole = parts(hits)
    good = whole.where(fits(whole, day, domains, own, opponent, signals))
    keyed = good.select(pool, seq, "section", urls.article_key(F.col("url"), F.col("it")["at"]).alias("key"), ranking.title_key(F.col("title")).alias("title"))
    chosen = ranking.first_keys(keyed, pool, seq, "key", "title", "section", pool_cap(articles))
    few = parts(hits.join(chosen, [pool, seq]))
    ordered = with_order(few, day, aliases).withColumn("later", ~F.col("section"))
    order = [*ranking.pool_order("later"), F.col(seq)]
    return ranking.top_per(ordered, [pool], order, articles).select(pool, seq, "key", "rank")
