"""Collecting what is read: hits of the first query that has any, facts from them, articles of a country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import urls
from heddle.functions.fixed import THIN_BODY
from heddle.operators import pipelines, ranking


def first_answered(hits: DataFrame, request: str, query: str, domains: str) -> DataFrame:
    """Of the hits (request, query, url, domains, ...) of queries that are asked one after the other, those of the first one with an article of
    the provider's domains. A provider without domains has none. Later queries would not have been asked."""
    url = F.col("url")
    at = hits.select("*", F.explode(F.array(urls.parsed(url))).alias("__at"))
    good = at.where((F.size(domains) > 0) & urls.domain_allowed(url, F.col(domains), F.col("__at")) & urls.is_article(url, F.col("__at"))).drop("__at")
    first = good.groupBy(F.col(request).alias("__request")).agg(F.min(query).alias("__query"))
    met = good.join(first, (F.col(request) == F.col("__request")) & (F.col(query) == F.col("__query")))
    return met.drop("__request", "__query")


def facts(hits: DataFrame, request: str, query: str, seq: str, domains: str, text: Column, why: Column) -> tuple[DataFrame, DataFrame]:
    """(facts, notes): of each request the first hit by seq, of the first query with any, that has a ``text`` of facts and nothing
    against it (``why`` is null); and (request, hits, without_text, reasons) of what was looked at where none is left."""
    found = first_answered(hits, request, query, domains).withColumn("__text", text)
    judged = found.withColumn("__why", F.when(F.col("__text").isNotNull(), why))
    good = judged.where("__text is not null and __why is null")
    chosen = ranking.first_of(good, [request], [seq]).drop("__why").withColumnRenamed("__text", "text")
    reasons = F.array_join(F.array_sort(F.collect_set("__why")), ",").alias("reasons")
    notes = judged.groupBy(request).agg(F.count("*").alias("hits"), F.count_if(F.col("__text").isNull()).alias("without_text"), reasons, F.count_if(F.col("__text").isNotNull() & F.col("__why").isNull()).alias("__good"))
    return chosen, notes.where("__good = 0").drop("__good")


def body(fetched: Column, raw: Column, fetch_dead: Column, longest: int = 20_000) -> Column:
    """The longest text there is: the page, which isn't fetched where its outlet has blocked us lately and the index has a text, or the index's."""
    indexed = F.when(F.coalesce(raw, F.lit("")) != "", F.substring(raw, 1, longest))
    page = F.when(~(indexed.isNotNull() & fetch_dead), fetched)
    return F.when(F.coalesce(F.length(indexed), F.lit(-1)) > F.coalesce(F.length(page), F.lit(-1)), indexed).otherwise(page)


def articles(hits: DataFrame, group: str, seq: str, text: str, played: Column, quoted: Column, home: Column, away: Column, n: int = 2) -> DataFrame:
    """(group, seq, thin, rescued, rank): up to ``n`` articles of a group, by seq. Hits (provider_id, text) of unknown outlets are left
    out; ``played`` says that a hit is on a match that has been, ``quoted`` that there was something to quote. Those with a full body come
    first and thin ones fill up. A group that would have none gets the first hit that wasn't taken for one on a match that has been but has its score."""
    known = hits.where(F.col("provider_id").isNotNull()).withColumns({"__played": F.coalesce(played, F.lit(False)), "__quoted": F.coalesce(quoted, F.lit(False))})
    thin = (F.coalesce(F.length(text), F.lit(0)) < THIN_BODY).cast("int")
    taken = ranking.top_per(known.where("__played and __quoted").withColumn("thin", thin), [group], [F.col("thin"), F.col(seq)], n)
    taken = taken.select(group, seq, (F.col("thin") == 1).alias("thin"), F.lit(False).alias("rescued"), "rank")
    left = known.where("not __played").join(taken.select(F.col(group).alias("__group")).distinct(), F.col(group) == F.col("__group"), "left_anti")
    saved = pipelines.rescue(left, group, seq, text, home, away)
    return taken.unionAll(saved.select(group, seq, (thin == 1), F.lit(True), F.lit(1).cast("long")))
