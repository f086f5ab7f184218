"""Verdicts on drafts, as columns: "ok", or the name of the first rule that a draft breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import fixed
from heddle.functions.text import banned_hits, contains_verbatim, digit_tokens, fold, mentions_score, scores, sentence_count, trimmed, ungrouped
from heddle.operators.rules import first_failure

# Limits of the frame's fields; words that stand for no summary.
FRAME_LIMITS = {"hook": 70, "title_body": 240, "caption": 600, "cta": 160}
NO_SUMMARY = ("", "null", "none", "brak")


def _score_parts(score: Column) -> tuple[Column, Column]:
    pattern = r"^\s*(\d{1,2})\s*[-:]\s*(\d{1,2})\s*$"
    return F.regexp_extract(score, pattern, 1), F.regexp_extract(score, pattern, 2)


def repeats_score(text: Column, score: Column) -> Column:
    a, b = _score_parts(score)
    return F.coalesce((a != "") & mentions_score(scores(text), a, b), F.lit(False))


def unknown_digits(text: Column, pool: Column, joined: Callable[[Column], Column] = ungrouped) -> Column:
    return F.array_except(digit_tokens(text, joined), digit_tokens(pool, joined))


def unknown_but_stages(text: Column, pool: Column) -> Column:
    return unknown_digits(F.regexp_replace(text, fixed.STAGE_FRACTION, " "), pool)


def summary_verdict(
    summary: Column, article: Column, pool: Column, score: Column, banned: tuple[str, ...], said: Column | None = None,
    unknown: Callable[[Column, Column], Column] = unknown_but_stages, folded: Callable[[Column], Column] = fold,
) -> Column:
    """A summary is optional without an article; else enough closed sentences, not too long, with
    the pool's numbers only, without the final score and banned phrases. ``said`` is the part that may
    tell the score (all of it), ``unknown`` gives the text's numbers that the pool lacks, ``folded`` the
    text in which banned phrases are looked for."""
    text = trimmed(F.coalesce(summary, F.lit("")))
    text = F.when(F.lower(text).isin(*NO_SUMMARY), "").otherwise(text)
    ladder = [
        (text != "", "missing"),
        (sentence_count(text) >= fixed.SUMMARY_SENTENCES, "too_few_sentences"),
        (F.regexp_count(F.right(text, F.lit(3)), F.lit(fixed.SENTENCE_END)) > 0, "cut_off"),
        (F.length(text) <= fixed.SUMMARY_CHARS, "too_long"),
        (F.size(unknown(text, pool)) == 0, "unknown_digits"),
        (~repeats_score(text if said is None else said, score), "repeats_score"),
        (F.size(banned_hits(text, banned, folded)) == 0, "banned"),
    ]
    return F.when(F.coalesce(article, F.lit("")) == "", "ok").otherwise(first_failure(ladder))


def frame_verdict(
    frame: dict[str, Column], score: Column, pool: Column, based_on: Column, allowed: Column, banned: tuple[str, ...], said: dict[str, Column] | None = None,
    unknown: Callable[[Column, Column], Column] = unknown_digits, folded: Callable[[Column], Column] = fold,
) -> Column:
    """Fields present and within limits, no score in hook and title, the call to action a question,
    nothing banned, the pool's numbers only, based on known quotes. ``said`` has what of hook and title
    may tell the score (all of both); ``unknown`` and ``folded`` are as in ``summary_verdict``."""
    value = {k: trimmed(F.coalesce(c, F.lit(""))) for k, c in frame.items()}
    said = {k: value[k] for k in ("hook", "title_body")} if said is None else said
    ladder = [rule for k, n in FRAME_LIMITS.items() for rule in ((value[k] != "", f"empty_{k}"), (F.length(value[k]) <= n, f"long_{k}"))]
    whole = F.concat_ws(" ", *(value[k] for k in FRAME_LIMITS))
    ladder += [(~repeats_score(c, score), f"score_in_{k}") for k, c in said.items()]
    ladder += [
        (value["cta"].endswith("?"), "cta_no_question"),
        (F.size(banned_hits(whole, banned, folded)) == 0, "banned"),
        (F.size(unknown(whole, F.concat_ws(" ", pool, score))) == 0, "unknown_digits"),
        (F.size(based_on) > 0, "based_on_empty"),
        (F.size(F.array_except(based_on, allowed)) == 0, "based_on_unknown"),
    ]
    return first_failure(ladder)


def facts_verdict(home: Column, away: Column, full_time: Column) -> Column:
    """Two different teams and a score."""
    norm = lambda c: F.btrim(F.regexp_replace(fold(c), r"\s+", " "))
    present = (F.btrim(F.coalesce(home, F.lit(""))) != "") & (F.btrim(F.coalesce(away, F.lit(""))) != "")
    return first_failure([(present, "empty_team"), (norm(home) != norm(away), "same_team"), (full_time.rlike(r"^\d{1,2}-\d{1,2}$"), "bad_score")])


def goal_verdict(team: Column, home: Column, away: Column, player: Column, minute: Column, source: Column) -> Column:
    """A goal of one of the teams by a scorer whom the source names; "dropped" outside the match."""
    norm = lambda c: F.btrim(F.regexp_replace(fold(c), r"\s+", " "))
    ladder = [(norm(team).isin(norm(home), norm(away)), "foreign_team"), (F.btrim(F.coalesce(player, F.lit(""))) != "", "empty_player"), (contains_verbatim(source, player), "unknown_player"), (minute.between(1, 130), "dropped")]
    return first_failure(ladder)


def draft_mismatch(home: Column, away: Column, day: Column, want_home: Column, want_away: Column, want_day: Column) -> Column:
    """Why a draft is on another match: "teams", "date", or null. Without expected teams or a date
    that part isn't compared; a date that can't be read is a mismatch."""
    from heddle.functions.urls import day_gap

    same = (F.least(home, away) == F.least(want_home, want_away)) & (F.greatest(home, away) == F.greatest(want_home, want_away))
    asked = F.coalesce(want_day, F.lit("")) != ""
    given = F.coalesce(day, F.lit("")) != ""
    off = asked & given & (day != want_day) & ~F.coalesce(day_gap(day, want_day) <= 1, F.lit(False))
    return F.when(want_home.isNotNull() & want_away.isNotNull() & ~same, "teams").when(off, "date")
