"""Compositions: fact providers in order, corroborated facts, rescues, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import fixed
from heddle.functions.text import sanitise, scores
from heddle.operators import evidence, lookup, ranking
from heddle.operators.rules import NONE, REVIEW


def facts_text(fetched: Column, raw: Column, title: Column, snippet: Column) -> Column:
    """The first of page, index content and title with snippet that has a score after cleaning."""
    either = F.when(F.coalesce(title, F.lit("")) != "", True).otherwise(F.coalesce(snippet, F.lit("")) != "")
    short = F.when(either, F.concat_ws(". ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    clean = [sanitise(F.substring(c, 1, 20_000)) for c in (fetched, raw, short)]
    return F.coalesce(*(F.when(c.rlike(fixed.SCORE_HINT), c) for c in clean))


def rescue(rejected: DataFrame, group: str, seq: str, text: str, home: Column, away: Column) -> DataFrame:
    """Of each group the first rejected row whose text has the final score in either orientation."""
    from heddle.functions.text import mentions_score

    fits = rejected.where(F.coalesce(mentions_score(scores(F.col(text)), home, away), F.lit(False)))
    return ranking.first_of(fits, [group], [seq])


def recurate(pool: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """The pool without what was picked before."""
    return pool.join(picks.select(key).distinct(), key, "left_anti")


def corroborated_facts(drafts: DataFrame, key: str, provider: str, home: str, away: str, score: str, seq: str, least: int = 2) -> DataFrame:
    """(key, score, sources): scores turned to the order of the two names, that at least so many
    different providers give; the one with most, the first seen of equals."""
    a, b = F.split_part(F.col(score), F.lit("-"), F.lit(1)), F.split_part(F.col(score), F.lit("-"), F.lit(2))
    turned = F.when(F.col(home) <= F.col(away), F.col(score)).otherwise(F.concat_ws("-", b, a))
    found = evidence.corroborated(drafts.withColumn("value", turned), [key], "value", provider, F.col(seq), least)
    return evidence.winner(found, [key], "value").select(key, F.col("value").alias("score"), "sources")


def resolution(asked: DataFrame, docs: DataFrame, query_tokens: Column, doc_tokens: Column) -> DataFrame:
    """(query_id, status, match_id): resolved, or a date that differs needs review, or no match.
    asked has query_id and date_hint, docs match_id and day."""
    best = lookup.resolve_tokens(asked, docs, query_tokens, doc_tokens, "query_id", "match_id")
    joined = asked.select("query_id", "date_hint").join(best, "query_id", "left").join(docs.select("match_id", "day"), "match_id", "left")
    differs = F.col("date_hint").isNotNull() & ~F.col("date_hint").eqNullSafe(F.col("day"))
    status = F.when(F.col("match_id").isNull(), NONE).when(differs, REVIEW).otherwise("resolved")
    return joined.select("query_id", status.alias("status"), "match_id")


def available(panels: Column) -> Column:
    """Status before assembly, by how many countries have media; null goes on."""
    return F.when(panels == 0, NONE).when(panels == 1, REVIEW)


def x_post(rows: DataFrame, entity: str, seq: str, outlet: Column, country: Column, body: Column) -> DataFrame:
    """(entity, post): a block for each quote with a body, headed by outlet and country, or by the
    country alone where the body names the outlet."""
    from heddle.operators.reports import ordered_text

    named = F.contains(F.lower(body), F.lower(outlet))
    head = F.when(named, F.concat(country, F.lit(":"))).otherwise(F.concat(outlet, F.lit(" ("), country, F.lit("):")))
    return ordered_text(rows.where(F.coalesce(body, F.lit("")) != ""), entity, seq, F.concat(head, F.lit("\n"), body), "post", "\n\n")


def last_sentence(text: Column) -> Column:
    """The last sentence of a text that ends in a question, else null."""
    parts = F.split(F.btrim(text), r"(?<=[.!?…])\s+(?=[A-ZĄĆĘŁŃÓŚŹŻ\"„'(])")
    return F.when(F.btrim(text).endswith("?"), F.btrim(F.element_at(parts, -1)))


def name_variants(names: Column, english: Column, fallback: Column, limit: int = 3) -> Column:
    """Local names first, then the full one, then the English one; no repeats; never none."""
    local = F.concat(F.slice(names, 3, 100), F.slice(names, 2, 1), F.when(english.isNotNull(), F.array(english)).otherwise(F.array().cast("array<string>")))
    local = F.when(F.size(local) == 0, F.slice(names, 1, 1)).otherwise(local)
    local = F.slice(F.array_distinct(local), 1, limit)
    return F.when(F.coalesce(F.size(local), F.lit(0)) > 0, local).otherwise(F.array(fallback))
