"""Assembly: numbering, source lists, hashtags, insights and angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.fixed import MAX_HASHTAGS, POSSESSION_GAP, SHOTS_GAP
from heddle.functions.text import fold_jvm, hashtag_slug


def numbered(parts: DataFrame, entity: str, bucket: str, seq: str) -> DataFrame:
    """Slides numbered from 1 in the order title, quotes, sources."""
    return parts.withColumn("slide", F.row_number().over(Window.partitionBy(entity).orderBy(bucket, seq)).cast("long"))


def ordered_text(rows: DataFrame, entity: str, seq: str, line: Column, name: str, separator: str = "\n") -> DataFrame:
    """Lines of each entity in order, joined."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(seq), line.alias("__line"))))
    return rows.groupBy(entity).agg(F.array_join(F.transform(gathered, lambda s: s["__line"]), separator).alias(name))


def sources(rows: DataFrame, entity: str, seq: str, url: str, line: Column, name: str) -> DataFrame:
    """As ordered_text, each URL of an entity once, the first."""
    first = rows.where(F.coalesce(F.btrim(url), F.lit("")) != "").groupBy(entity, url).agg(F.min_by(F.struct(F.col(seq), line.alias("__line")), seq).alias("__s"))
    return ordered_text(first.select(entity, f"__s.{seq}", "__s.__line"), entity, seq, F.col("__line"), name)


def hashtags(base: list[str], names: Column, limit: int = MAX_HASHTAGS) -> Column:
    """Base tags, then one of each name whose slug has 2 to 30 characters; no repeats, cut."""
    slugs = F.transform(names, lambda x: hashtag_slug(x, fold_jvm))
    tags = F.transform(F.filter(slugs, lambda s: F.length(s).between(2, 30)), lambda s: F.concat(F.lit("#"), s))
    return F.slice(F.array_distinct(F.concat(F.array(*map(F.lit, base)), tags)), 1, limit)


def insights(rows: DataFrame, entity: str) -> DataFrame:
    """(entity, kind, confidence) from home and away possession and shots, and penalties."""
    possession, shots = F.col("home_possession") - F.col("away_possession"), F.col("home_shots") - F.col("away_shots")
    found = F.array(
        F.when(F.col("penalties"), F.struct(F.lit("penalty_final").alias("kind"), F.lit("high").alias("confidence"))),
        F.when(F.abs(possession) >= POSSESSION_GAP, F.struct(F.lit("possession_vs_finish").alias("kind"), F.lit("high").alias("confidence"))),
        F.when(F.abs(shots) >= SHOTS_GAP, F.struct(F.lit("shot_volume").alias("kind"), F.lit("medium").alias("confidence"))),
    )
    return rows.select(entity, F.inline(F.array_compact(found)))


def angle(rows: DataFrame, entity: str) -> DataFrame:
    """(entity, archetype, total): candidates in order, the highest total, the first of equals."""
    both = F.col("home_possession").isNotNull() & F.col("away_possession").isNotNull() & F.col("penalties")
    one = F.col("home_shots").isNotNull() & F.col("penalties")
    candidate = lambda when, name, total: F.when(when, F.struct(F.lit(total).alias("total"), F.lit(name).alias("archetype")))
    found = F.array_compact(F.array(candidate(both, "possession_trap", 10), candidate(one, "one_number", 8)))
    some = F.coalesce("home_possession", "away_possession", "home_shots", "away_shots").isNotNull()
    fallback = F.when(some, F.struct(F.lit(5).alias("total"), F.lit("three_numbers").alias("archetype")))
    best = F.coalesce(F.try_element_at(found, F.lit(1)), fallback)
    return rows.select(entity, best["archetype"].alias("archetype"), best["total"].cast("long").alias("total"))
