"""Evidence: ledger, missing and used claims, conflicts, corroboration, provider checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.urls import domain_allowed


def missing(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Distinct claim keys without evidence."""
    return claims.select(key).distinct().join(evidence.select(key).distinct(), key, "left_anti")


def mark_used(ledger: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """The ledger with a flag for rows that a claim uses."""
    flagged = claims.select(key).distinct().withColumn("__used", F.lit(True))
    return ledger.join(flagged, key, "left").withColumn("used", F.coalesce("__used", F.lit(False))).drop("__used")


def low_confidence(claims: DataFrame, ledger: DataFrame, key: str, is_low: Column) -> DataFrame:
    return claims.select(key).distinct().join(ledger.where(is_low).select(key), key, "left_semi")


def conflicts(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value isn't that of their key's current holder, with the value they replace."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("previous", before).where(F.col("previous") != F.col(value))


def latest(rows: DataFrame, key: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """The last row of each key: an aggregation, so that no key is sorted."""
    last = F.max_by(F.struct(*kept), F.struct(*order)).alias("last")
    return rows.groupBy(*key).agg(last).select(*key, *(F.col(f"last.{c}").alias(c) for c in kept))


def corroborated(rows: DataFrame, key: list[str], value: str, source: str, seq: Column, least: int = 2) -> DataFrame:
    """(key, value, sources, first_seq): values that enough different sources give."""
    found = rows.groupBy(*key, value).agg(F.count_distinct(source).alias("sources"), F.min(seq).alias("first_seq"))
    return found.where(F.col("sources") >= least)


def winner(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Of ``corroborated`` values the one with most sources; the first seen of equals."""
    best = F.min_by(F.struct(value, "sources", "first_seq"), F.struct(-F.col("sources"), "first_seq", value)).alias("best")
    return rows.groupBy(*key).agg(best).select(*key, f"best.{value}", "best.sources", "best.first_seq")


def check_providers(rows: DataFrame, providers: DataFrame, url: str = "url", provider: str = "provider_id", declared: str | None = None) -> DataFrame:
    """Rows with tier and reason: null if the provider is known, has the tier that the row declares (where ``declared`` names that column) and
    the URL is in its domains."""
    known = providers.select(F.col(provider).alias("__provider"), F.col("tier").alias("__tier"), F.col("domains").alias("__domains"))
    joined = rows.join(known, F.col(provider) == F.col("__provider"), "left")
    reason = F.when(F.col("__tier").isNull(), "unknown_provider")
    if declared is not None:
        reason = reason.when(~F.col(declared).eqNullSafe(F.col("__tier")), "tier_mismatch")
    reason = reason.when(~domain_allowed(F.col(url), F.col("__domains")), "domain_not_allowed")
    names = [c for c in rows.columns if c not in ("tier", "reason")]
    return joined.select(*(F.col(c) for c in names), F.col("__tier").alias("tier"), reason.alias("reason"))


def claim_ids(rows: DataFrame, entity: str, ids: str) -> DataFrame:
    """Sorted distinct claim ids of each entity, joined by commas."""
    each = rows.select(entity, F.explode(ids).alias("__id"))
    return each.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_set("__id")), ",").alias("claim_ids"))


def missing_originals(quotes: DataFrame, ledger: DataFrame, key: str, original: Column) -> DataFrame:
    """Keys of quotes whose evidence has no original text."""
    texts = ledger.select(key, original.alias("__original"))
    joined = quotes.select(key).join(texts, key, "left")
    return joined.where(F.coalesce(F.btrim("__original"), F.lit("")) == "").select(key).distinct()
