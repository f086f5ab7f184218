"""Lookups that are joins: by domain suffix, text containment, unordered pair and day, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import fold, quoted
from heddle.functions.urls import host, host_suffixes
from heddle.sources.sinks import materialised


def outlet_for_url(rows: DataFrame, outlets: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, provider_id) of the first outlet, by tier and id, whose domain has the URL's host.
    Host suffixes turn the suffix test into an equi-join."""
    asked = rows.select(key, F.explode(host_suffixes(host(F.col(url)))).alias("domain"))
    met = asked.join(outlets.select("provider_id", "tier", "domain"), "domain")
    return met.groupBy(key).agg(F.min_by("provider_id", F.struct("tier", "provider_id")).alias("provider_id"))


def names_in_text(rows: DataFrame, names: dict[str, str], key: str, text: Column) -> DataFrame:
    """(key, name, position): whole-word mentions of each alias's name, the earliest each.
    The aliases, a dimension of known size, become one pattern; longer aliases win at a place."""
    aliases = sorted(names, key=lambda a: (-len(a), a))
    pattern = "(?<![a-z0-9])(" + "|".join(map(quoted, aliases)) + ")(?![a-z0-9])"
    found = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("position", "alias"))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    named = found.withColumn("name", table[F.col("alias")])
    first = named.groupBy(key, "name").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("position"))
    return first.withColumn("position", rank.cast("long"))


def match_name(rows: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Equi-join on the folded name: (key, canonical) or the name itself where none is known."""
    asked = rows.select(key, name, fold(F.btrim(F.col(name))).alias("alias"))
    joined = asked.join(dim.select("alias", "canonical"), "alias", "left")
    return joined.select(key, F.coalesce("canonical", name).alias("canonical"))


def pair_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi")]


def scheduled(asked: DataFrame, schedule: DataFrame, key: str, match_id: str) -> DataFrame:
    """(key, match) for asked (key, pair_lo, pair_hi, day) and a schedule (match, pair_lo, pair_hi,
    day): the same pair in any order, on the day, else a day off; without a day the latest.

    Who asks for a day asks for three, so the day is part of the join's key and a pair with a long history is not looked
    through; who asks for none meets one row, the pair's latest, which an aggregation finds."""
    pair = ["pair_lo", "pair_hi"]
    dated = asked.where(F.col("day").isNotNull()).select(key, *pair, F.col("day").alias("wanted"), F.explode(F.array(F.date_sub("day", 1), "day", F.date_add("day", 1))).alias("day"))
    met = dated.join(schedule.select(match_id, *pair, "day"), [*pair, "day"])
    best = F.max_by(match_id, F.struct(F.col("day") == F.col("wanted"), "day", match_id))
    near = met.groupBy(key).agg(best.alias(match_id))
    last = schedule.groupBy(*pair).agg(F.max_by(match_id, F.struct("day", match_id)).alias(match_id))
    return near.unionAll(asked.where(F.col("day").isNull()).select(key, *pair).join(last, pair).select(key, match_id))


#: Sets of tokens that a token may be in to count as rare: what is searched first costs no more for each.
RARE = 64


def _sets(rows: DataFrame, key: str, token: str) -> DataFrame:
    """(tokens, key) from (key, token): each different set of tokens, with the smallest key that has it."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(token)).alias("tokens")).groupBy("tokens").agg(F.min(key).alias(key))


def _verified(asked: DataFrame, postings: DataFrame, sets: DataFrame, query: str, doc: str, least: int) -> DataFrame:
    """(query, best struct<overlap, doc>) among the sets that share one of the asked tokens (query, tokens, asked, unasked: how many
    of the query's tokens are not among these). Sets that can't reach what another one has for certain are not looked at."""
    met = asked.select(query, "unasked", F.explode("asked").alias("token")).join(postings, "token")
    found = met.groupBy(query, doc).agg(F.count("*").alias("found"), F.first("unasked").alias("unasked"))
    bound = found.groupBy(F.col(query).alias("__q")).agg(F.max("found").alias("sure"))
    able = (F.col("found") + F.col("unasked") >= F.greatest("sure", F.lit(least)))
    survivors = found.join(bound, F.col(query) == F.col("__q")).where(able).select(query, doc)
    both = survivors.join(asked.select(query, "tokens"), query).join(sets.withColumnRenamed("tokens", "__has"), doc)
    counted = both.select(query, doc, F.size(F.array_intersect("tokens", "__has")).alias("overlap")).where(F.col("overlap") >= least)
    return counted.groupBy(query).agg(F.min_by(F.struct("overlap", doc), F.struct(-F.col("overlap"), doc)).alias("best"))


def resolve_tokens(queries: DataFrame, docs: DataFrame, query_tokens: Column, doc_tokens: Column, query: str, doc: str, least: int = 2, rare: int = RARE) -> DataFrame:
    """(query, doc, overlap): most distinct common tokens of more than one character, ``least`` or more; equal ones by the
    smallest doc.

    Tokens that no query has are left out, and then docs, and queries, with equal sets of tokens are one. Of each query the rare tokens
    are searched first, by an equi-join. What they find bounds how many more tokens must be searched: a set that has none of
    a query's first r of m tokens, rarest first, shares m - r at most. So frequent tokens are searched only for queries that have found
    too little without them, and only as many as can still matter; overlaps are counted for sets that can be the best."""
    words = lambda d, k, c: d.select(k, F.explode(F.array_distinct(c)).alias("token")).where(F.length("token") > 1)
    own = words(queries, query, query_tokens).groupBy(query).agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    own = materialised(own)
    vocabulary = own.select(F.explode("tokens").alias("token")).distinct()
    sets = materialised(_sets(words(docs, doc, doc_tokens).join(vocabulary, "token", "left_semi"), doc, "token").where(F.size("tokens") >= least))
    postings = sets.select(doc, F.explode("tokens").alias("token"))
    frequency = postings.groupBy("token").agg(F.count("*").alias("n"))

    groups = own.groupBy("tokens").agg(F.min(query).alias(query))
    ranked = groups.select(query, F.explode("tokens").alias("token")).join(frequency, "token")
    ranked = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("r")).where(F.size("r") >= least)
    size = F.size("r")
    first = F.least(F.greatest(F.size(F.filter("r", lambda t: t["n"] <= rare)), F.lit(1)), size - least + 1)
    ranked = materialised(ranked.select(query, F.transform("r", lambda t: t["token"]).alias("tokens"), size.alias("m"), first.alias("p")))

    asked = ranked.select(query, "tokens", F.slice("tokens", F.lit(1), F.col("p")).alias("asked"), (F.col("m") - F.col("p")).alias("unasked"))
    early = materialised(_verified(asked, postings, sets, query, doc, least))
    # what shares none of the first p tokens has m - p at most; from this place on it can't be as good as what is known
    enough = F.col("m") - F.greatest(F.coalesce("best.overlap", F.lit(0)), F.lit(least)) + 1
    more = ranked.join(early, query, "left").withColumn("upto", enough).where(F.col("upto") > F.col("p"))
    more = more.select(query, "tokens", F.slice("tokens", F.col("p") + 1, F.col("upto") - F.col("p")).alias("asked"), (F.col("m") - F.col("upto") + F.col("p")).alias("unasked"))
    best = early.unionAll(_verified(more, postings, sets, query, doc, least))
    best = best.groupBy(query).agg(F.min_by("best", F.struct(-F.col("best.overlap"), f"best.{doc}")).alias("best"))

    group = own.join(groups.select("tokens", F.col(query).alias("__group")), "tokens")
    chosen = best.select(F.col(query).alias("__group"), f"best.{doc}", F.col("best.overlap").cast("long").alias("overlap"))
    return group.join(chosen, "__group").select(query, doc, "overlap")


def quote_for_slide(slides: DataFrame, quotes: DataFrame) -> DataFrame:
    """Slides (slide_id, claim_id, headline) with the quote of their claim, else the first quote
    whose outlet the headline names."""
    by_claim = slides.join(quotes.groupBy("claim_id").agg(F.min("quote_id").alias("by_claim")), "claim_id", "left")
    outlets = quotes.groupBy("outlet").agg(F.min("quote_id").alias("q"))
    words = slides.select("slide_id", F.explode(F.split(F.lower("headline"), "[^a-z0-9]+")).alias("outlet"))
    by_name = words.join(outlets, "outlet").groupBy("slide_id").agg(F.min("q").alias("by_name"))
    return by_claim.join(by_name, "slide_id", "left").select("slide_id", F.coalesce("by_claim", "by_name").alias("quote_id"))


def attribution(rows: DataFrame, ids: str, dim: DataFrame, key: str) -> DataFrame:
    """(key, outlet) of the first of the listed ids that the dimension knows."""
    each = rows.select(key, F.posexplode(ids).alias("__at", "id")).join(dim, "id")
    return each.groupBy(key).agg(F.min_by("outlet", "__at").alias("outlet"))


def enrich(facts: DataFrame, schedule: DataFrame, key: str) -> DataFrame:
    """Venue and day from the schedule where it has them; stage only where the facts have none."""
    joined = facts.join(schedule.select(key, F.col("venue").alias("__venue"), F.col("day").alias("__day"), F.col("stage").alias("__stage")), key, "left")
    unknown = (F.coalesce("stage", F.lit("")) == "") | F.lower("stage").startswith("nieznan")
    return joined.select(key, F.coalesce("__venue", "venue").alias("venue"), F.coalesce("__day", "day").alias("day"), F.when(unknown, F.coalesce("__stage", "stage")).otherwise(F.col("stage")).alias("stage"))


def best_status(left: DataFrame, runs: DataFrame, key: str, rank: Column, seq: str, status: str, none: str) -> DataFrame:
    """(key, status): of each key's runs the highest rank, the last of equals; ``none`` without."""
    best = runs.groupBy(key).agg(F.max_by(status, F.struct(rank, seq)).alias(status))
    return left.select(key).join(best, key, "left").withColumn(status, F.coalesce(status, F.lit(none)))


def expand_templates(teams: DataFrame, templates: list[str], limit: int = 8) -> DataFrame:
    """(team_id, position, query): every name variant in every template, in order, without repeats.
    Templates are a literal list, so this is an array expression and not a join."""
    filled = F.flatten(F.transform("variants", lambda v: F.array(*(F.replace(F.replace(F.lit(t), F.lit("{team}"), v), F.lit("{opponent}"), F.col("opponent")) for t in templates))))
    return teams.select("team_id", F.posexplode(F.slice(F.array_distinct(filled), 1, limit)).alias("position", "query"))


def first_alias(text: Column, aliases: list[tuple[str, str]], default: str) -> Column:
    """The value of the first alias that the folded text contains."""
    folded, out = fold(text), F
    for alias, value in aliases:
        out = out.when(F.contains(folded, F.lit(alias)), value)
    return out.otherwise(default)
