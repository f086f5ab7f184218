"""Validation rules: each is a row (entity, check, result, details); status rolls them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.fixed import ANGLE_TOTAL

READY, REVIEW, NONE = "ready", "needs_human_review", "insufficient_evidence"


def checks(rows: DataFrame, entity: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(entity, check, result, details) of every rule (condition, details), in one pass."""
    structs = F.array(*(F.struct(F.lit(n).alias("check"), F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail").alias("result"), F.coalesce(d.cast("string"), F.lit("")).alias("details")) for n, (c, d) in rules.items()))
    return rows.select(entity, F.inline(structs))


def report(rows: DataFrame, entity: str) -> DataFrame:
    """(entity, status, blocking): blocking names in order, joined by commas."""
    failed = F.array_sort(F.collect_list(F.when(F.col("result") == "fail", F.col("check"))))
    found = rows.groupBy(entity).agg(F.array_join(failed, ",").alias("blocking"))
    return found.withColumn("status", F.when(F.col("blocking") == "", "pass").otherwise(REVIEW))


def final_status(facts: Column, quality: Column, unconfirmed: Column | None = None) -> Column:
    """Ready if both pass and the score is confirmed."""
    good = (facts == "pass") & (quality == "pass")
    return F.when(F.coalesce(good & ~unconfirmed if unconfirmed is not None else good, F.lit(False)), READY).otherwise(REVIEW)


def leaderboard(facts: Column, quality: Column, angle_total: Column) -> Column:
    return F.when(facts == "pass", 40).otherwise(0) + F.when(quality == "pass", 40).otherwise(0) + F.when(angle_total >= ANGLE_TOTAL, 20).otherwise(0)


def summary(rows: DataFrame, passed: Column) -> DataFrame:
    """One row: total, passed, failed, pass_rate to three digits, 0 without rows."""
    good = F.count_if(passed)
    return rows.agg(F.count("*").alias("total"), good.alias("passed"), (F.count("*") - good).alias("failed"), F.coalesce(F.round(good / F.nullif(F.count("*"), F.lit(0)), 3), F.lit(0.0)).alias("pass_rate"))


def scenario(expected: DataFrame, actual: DataFrame, entity: str) -> DataFrame:
    """(entity, missing, wrong): expected (entity, check, result) that actual rows don't show."""
    joined = expected.join(actual.select(entity, "check", F.col("result").alias("__got")), [entity, "check"], "left")
    return joined.groupBy(entity).agg(F.count_if(F.col("__got").isNull()).alias("missing"), F.count_if(F.col("__got") != F.col("result")).alias("wrong"))


def first_failure(rules: list[tuple[Column, str]], good: str = "ok") -> Column:
    """The name of the first rule that fails."""
    out = F
    for condition, name in rules:
        out = out.when(~F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(good)


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
