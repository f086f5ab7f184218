"""Judges of whole packages: every check of a kind in one pass, as rows (entity, check, result, details).

A package is a row for each entity, with its parts (slides, segments, quotes, panels) in tables of
their own; each part is one aggregation. An entity of ``runs`` without a package has the one failed check
``package_exists``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.fixed import FAIR_USE
from heddle.functions.text import banned_hits, mentions_score, scores
from heddle.operators.rules import first_failure, leaderboard

# How many slides a carousel has, how its first segment begins, what no asset may be.
SLIDES, FIRST_SEGMENT, NO_ASSET = (5, 7), "0-3", "fragment transmisji"

Rules = dict[str, tuple[Column, Column | str]]


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _in_order(value: Column | str, order: str = "position") -> Column:
    """The group's values in their order, joined by spaces."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(value, F.lit("")).alias("value"))))
    return F.array_join(F.transform(pairs, lambda p: p["value"]), " ")


def _listed(condition: Column, value: str) -> Column:
    """The group's values that meet a condition, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col(value).cast("string")))), ", ")


def _judged(rows: DataFrame, entity: str, exists: str, rules: Rules) -> DataFrame:
    """One row for each rule of an entity that exists, else one that it doesn't."""

    def row(name: str, good: Column, details: Column | str) -> Column:
        said = F.lit(details) if isinstance(details, str) else F.coalesce(details.cast("string"), F.lit(""))
        result = F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail")
        return F.struct(F.lit(name).alias("check"), result.alias("result"), said.alias("details"))

    every = F.array(*(row(name, *rule) for name, rule in rules.items()))
    none = F.array(row("package_exists", F.lit(False), ""))
    return rows.select(entity, F.inline(F.when(F.col(exists).isNotNull(), every).otherwise(none)))


def copy_shape(packages: DataFrame, segments: DataFrame, slides: DataFrame, entity: str) -> DataFrame:
    """A row for each package with what its rules look at: number of slides, first and last role, the
    first headline and segment, and all text for the audience."""
    of_slides = slides.groupBy(entity).agg(
        F.count("*").alias("n_slides"),
        F.min_by("role", "position").alias("first_role"),
        F.max_by("role", "position").alias("last_role"),
        F.min_by("headline", "position").alias("first_headline"),
        F.concat_ws(" ", _in_order(F.col("headline")), _in_order(F.col("body"))).alias("slide_text"),
    )
    of_segments = segments.groupBy(entity).agg(
        F.min_by("time_range", "position").alias("first_range"), _in_order(F.col("text")).alias("segment_text")
    )
    rows = packages.withColumn("package", F.lit(True)).join(of_slides, entity, "left").join(of_segments, entity, "left")
    return rows.withColumn("copy", F.concat_ws(" ", "hook", "cta", "caption", "source_note", "segment_text", "slide_text"))


def quality_checks(runs: DataFrame, shape: DataFrame, entity: str, banned: tuple[str, ...]) -> DataFrame:
    """The nine checks of a package, from ``copy_shape`` rows that also have thesis, main_number_id and
    safe_assets."""
    rows = runs.select(entity).join(shape, entity, "left").withColumn("hits", banned_hits(F.col("copy"), banned))
    first = F.coalesce(F.col("first_range").startswith(FIRST_SEGMENT), F.lit(False))
    return _judged(rows, entity, "package", {
        "single_angle": (_filled("thesis"), F.col("thesis")),
        "hook_first_three_seconds": (_filled("hook") & first, ""),
        "carousel_has_5_to_7_slides": (F.coalesce("n_slides", F.lit(0)).between(*SLIDES), F.coalesce("n_slides", F.lit(0))),
        "slide_one_is_tension": ((F.col("first_role") == "hook") & ~F.contains(F.substring("first_headline", 1, 3), F.lit("?")), ""),
        "main_number_present": (_filled("main_number_id"), ""),
        "cta_present": (_filled("cta") & (F.col("last_role") == "cta"), ""),
        "source_note_present": (_filled("source_note"), ""),
        "no_broadcast_clips": (~F.contains(F.lower(F.coalesce("safe_assets", F.lit(""))), F.lit(NO_ASSET)), "visual brief lists safe asset types only"),
        "no_banned_phrases": (F.size("hits") == 0, F.array_join("hits", ", ")),
    })


def copy_verdicts(shape: DataFrame, claims: DataFrame, evidence: DataFrame, entity: str, banned: tuple[str, ...]) -> DataFrame:
    """(entity, verdict) of a draft: the first rule of its structure, claims (entity, id) or wording that it
    breaks."""
    unknown = claims.select(entity, "id").distinct().join(evidence.select(entity, "id").distinct(), [entity, "id"], "left_anti")
    rows = shape.join(unknown.groupBy(entity).agg(F.count("*").alias("n_unknown")), entity, "left")
    ladder = [
        (_filled("hook"), "empty_hook"),
        (F.col("first_range").startswith(FIRST_SEGMENT), "late_hook"),
        (F.col("n_slides").between(*SLIDES), "slide_count"),
        (F.col("first_role") == "hook", "first_slide"),
        (F.col("last_role") == "cta", "last_slide"),
        (_filled("cta"), "empty_cta"),
        (_filled("source_note"), "no_source_note"),
        (F.coalesce("n_unknown", F.lit(0)) == 0, "unknown_claims"),
        (F.size(banned_hits(F.col("copy"), banned)) == 0, "banned"),
    ]
    return rows.select(entity, first_failure(ladder).alias("verdict"))


def _final(score: str) -> tuple[Column, Column]:
    pattern = r"^\s*(\d{1,2})\s*[-:]\s*(\d{1,2})\s*$"
    return F.regexp_extract(score, pattern, 1), F.regexp_extract(score, pattern, 2)


def media_fact_checks(
    runs: DataFrame, packages: DataFrame, quotes: DataFrame, claims: DataFrame, evidence: DataFrame, conflicts: DataFrame, entity: str
) -> DataFrame:
    """The four checks of a media package (entity, score): claims (entity, id) have evidence (entity, id,
    original), none of it is in conflict (entity, id), quotes (entity, id, text) have their original there, and
    if quotes have scores, the final one is among them."""
    known = evidence.groupBy(entity, "id").agg(F.max("original").alias("original"))
    missing = claims.select(entity, "id").distinct().join(known, [entity, "id"], "left_anti")
    missing = missing.groupBy(entity).agg(_listed(F.lit(True), "id").alias("missing"))
    odd = conflicts.groupBy(entity).agg(_listed(F.lit(True), "id").alias("conflicts"))
    found = quotes.join(known, [entity, "id"], "left").withColumn("found", scores(F.coalesce("text", F.lit(""))))
    of_quotes = found.groupBy(entity).agg(
        _listed(F.coalesce("original", F.lit("")) == "", "id").alias("bare"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"),
    )
    rows = runs.select(entity).join(packages.withColumn("package", F.lit(True)), entity, "left")
    for part in (missing, odd, of_quotes):
        rows = rows.join(part, entity, "left")
    a, b = _final("score")
    apart = (a != "") & (F.size("found") > 0) & ~mentions_score(F.col("found"), a, b)
    said = F.when(F.coalesce(apart, F.lit(False)), F.concat_ws(", ", "found"))
    return _judged(rows, entity, "package", {
        "all_claims_have_evidence": (~_filled("missing"), F.col("missing")),
        "no_source_conflicts": (~_filled("conflicts"), F.col("conflicts")),
        "original_retained_in_evidence": (~_filled("bare"), F.col("bare")),
        "score_consistent_with_media": (said.isNull(), said),
    })


def media_quality_checks(
    runs: DataFrame, packages: DataFrame, panels: DataFrame, quotes: DataFrame, slides: DataFrame, entity: str, banned: tuple[str, ...]
) -> DataFrame:
    """The eight checks of a media package (entity, score, headline, body, caption, source_note), its panels
    (entity, country, mood, source_count), quotes (entity, country, id, position, outlet, url, translation,
    summary) and slides (entity, position, role, headline, body)."""
    a, b = _final("score")
    quoted = quotes.join(packages.select(entity, "score"), entity)
    repeats = F.coalesce((a != "") & mentions_score(scores(F.coalesce("summary", F.lit(""))), a, b), F.lit(False))
    of_quotes = quoted.groupBy(entity).agg(
        F.bool_and(_filled("outlet") & _filled("url")).alias("named"),
        _listed(F.length("translation") > FAIR_USE, "id").alias("long"),
        _listed(repeats, "id").alias("repeated"),
        _in_order(F.col("translation")).alias("quote_text"),
    )
    per_country = quotes.groupBy(entity, "country").agg(F.count("*").alias("n"))
    of_panels = panels.join(per_country, [entity, "country"], "left").groupBy(entity).agg(
        F.count("*").alias("n_panels"),
        F.bool_and(F.coalesce("n", F.lit(0)) > 0).alias("all_quoted"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "country", F.coalesce("n", F.lit(0))))), ", ").alias("per_panel"),
        _listed(_filled("mood") & (F.col("source_count") < 2), "country").alias("bad_mood"),
        _in_order(F.col("mood"), "country").alias("mood_text"),
    )
    is_media = F.when(F.col("role") == "media_country", F.concat_ws(" ", "headline", "body"))
    of_slides = slides.groupBy(entity).agg(
        F.min_by("role", "position").alias("first_role"), F.max_by("role", "position").alias("last_role"), _in_order(is_media).alias("slide_text")
    )
    rows = runs.select(entity).join(packages.withColumn("package", F.lit(True)), entity, "left")
    for part in (of_quotes, of_panels, of_slides):
        rows = rows.join(part, entity, "left")
    whole = F.concat_ws(" ", "headline", "body", "caption", "source_note", "mood_text", "quote_text", "slide_text")
    rows = rows.withColumn("hits", banned_hits(whole, banned))
    return _judged(rows, entity, "package", {
        "both_countries_present": ((F.col("n_panels") >= 2) & F.col("all_quoted"), F.col("per_panel")),
        "every_quote_has_outlet_and_url": (F.col("named"), ""),
        "quote_within_fair_use_length": (~_filled("long"), F.col("long")),
        "mood_requires_two_sources": (~_filled("bad_mood"), F.col("bad_mood")),
        "score_only_on_title_slide": (~_filled("repeated"), F.col("repeated")),
        "title_slide_present": (F.col("first_role") == "title", ""),
        "sources_slide_present": (F.col("last_role") == "sources", ""),
        "no_banned_phrases": (F.size("hits") == 0, F.array_join("hits", ", ")),
    })


def scenario_results(scenarios: DataFrame, runs: DataFrame, checks: DataFrame, entity: str) -> DataFrame:
    """(entity, passed, failures, score): each scenario (entity, expected_status and the arrays must_pass,
    must_fail, expected_blocking, forbidden) against its run (entity, status, facts, quality, angle_total, copy) and
    the run's checks (entity, check, result). Failed checks are what blocks."""
    got = checks.groupBy(entity).agg(
        F.collect_set(F.when(F.col("result") == "pass", F.col("check"))).alias("good"),
        F.collect_set(F.when(F.col("result") == "fail", F.col("check"))).alias("bad"),
    )
    rows = scenarios.join(runs, entity, "left").join(got, entity, "left")
    none = F.array().cast("array<string>")
    array = lambda c: F.coalesce(F.col(c), none)
    named = lambda word, missed: F.transform(F.array_sort(missed), lambda x: F.concat(F.lit(f"{word}:"), x))
    low = F.lower(F.coalesce("copy", F.lit("")))
    there = F.filter(array("forbidden"), lambda x: F.contains(low, F.lower(x)))
    status = F.when(F.col("status").eqNullSafe(F.col("expected_status")), none).otherwise(F.array(F.lit("status")))
    failures = F.concat(
        status,
        named("not_passed", F.array_except(array("must_pass"), array("good"))),
        named("not_failed", F.array_except(array("must_fail"), array("bad"))),
        named("not_blocking", F.array_except(array("expected_blocking"), array("bad"))),
        named("forbidden", there),
    )
    score = F.coalesce(leaderboard(F.col("facts"), F.col("quality"), F.coalesce("angle_total", F.lit(0))), F.lit(0))
    rows = rows.withColumns({"failed": failures, "score": score})
    return rows.select(entity, (F.size("failed") == 0).alias("passed"), F.array_join("failed", ",").alias("failures"), "score")
