"""Judges and pools on small fixtures, for what the tables' texts never show."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import judges, pools, ranking

GOOD = {"thesis": "t", "hook": "h", "cta": "Why?", "caption": "c", "source_note": "s", "main_number_id": "e1", "safe_assets": "crowd photo"}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def shape(spark, change=(), slides=("hook", "a", "b", "c", "cta"), headline="Calm", time_range="0-3s"):
    values = {**GOOD, **dict(change)}
    packages = frame(spark, [("p", *values.values())], "k string, " + ", ".join(f"{c} string" for c in values))
    rows = [("p", i, role, headline if i == 0 else "x", "body") for i, role in enumerate(slides)]
    of_slides = frame(spark, rows, "k string, position int, role string, headline string, body string")
    segments = frame(spark, [("p", 0, time_range, "one"), ("p", 1, "3-9s", "two")], "k string, position int, time_range string, text string")
    return judges.copy_shape(packages, segments, of_slides, "k")


@pytest.mark.parametrize(("options", "failed"), [
    ({}, set()),
    ({"change": {"safe_assets": "a Fragment Transmisji of it"}}, {"no_broadcast_clips"}),
    ({"change": {"thesis": ""}}, {"single_angle"}),
    ({"change": {"cta": None}}, {"cta_present"}),
    ({"slides": ("hook", "a", "b", "c")}, {"carousel_has_5_to_7_slides", "cta_present"}),
    ({"headline": "Eh? Calm"}, {"slide_one_is_tension"}),
    ({"headline": "Calm? Yes"}, set()),
    ({"time_range": "1-4s"}, {"hook_first_three_seconds"}),
    ({"change": {"main_number_id": "", "source_note": ""}}, {"main_number_present", "source_note_present"}),
    ({"change": {"caption": "Magiczna noc"}}, {"no_banned_phrases"}),
])
def test_quality_checks(spark, options, failed):
    runs = frame(spark, [("p",), ("gone",)], "k string")
    rows = judges.quality_checks(runs, shape(spark, **options), "k", ("magiczn",)).collect()
    assert {r.check for r in rows if r.k == "p" and r.result == "fail"} == failed and sum(r.k == "p" for r in rows) == 9
    assert [(r.check, r.result) for r in rows if r.k == "gone"] == [("package_exists", "fail")]


def test_copy_verdicts(spark):
    claims, evidence = frame(spark, [("p", "a"), ("p", "b")], "k string, id string"), frame(spark, [("p", "a"), ("q", "b")], "k string, id string")
    verdict = lambda s: judges.copy_verdicts(s, claims, evidence, "k", ("magiczn",)).first().verdict
    assert verdict(shape(spark)) == "unknown_claims"
    assert verdict(shape(spark, change={"hook": ""})) == "empty_hook"
    assert verdict(shape(spark, slides=("a",) * 5)) == "first_slide"
    assert judges.copy_verdicts(shape(spark), claims.where("id = 'a'"), evidence, "k", ()).first().verdict == "ok"


def test_media_judges(spark):
    packages = frame(spark, [("p", "2-1", "", "", "", "")], "k string, score string, headline string, body string, caption string, source_note string")
    panels = frame(spark, [("p", "A", "happy", 2), ("p", "B", None, 1)], "k string, country string, mood string, source_count int")
    schema = "k string, country string, id string, position int, outlet string, url string, translation string, summary string"
    quotes = frame(spark, [("p", "A", "e1", 0, "o", "u", "x", "It ended 1:2."), ("p", "A", "e2", 1, "o", "u", "y" * 421, "Do przerwy 2-1."), ("p", "B", "e3", 2, "o", "", "z", None)], schema)
    slides = frame(spark, [("p", 0, "title", "", ""), ("p", 1, "sources", "Magiczna", "")], "k string, position int, role string, headline string, body string")
    rows = judges.media_quality_checks(packages, packages, panels, quotes, slides, "k", ("magiczn",)).collect()
    failed = {r.check: r.details for r in rows if r.result == "fail"}
    assert failed == {"every_quote_has_outlet_and_url": "", "quote_within_fair_use_length": "e2", "score_only_on_title_slide": "e1"}
    evidence = frame(spark, [("p", "e1", "orig"), ("p", "e2", "")], "k string, id string, original string")
    texts = quotes.select("k", "id", F.lit("It ended 3-0.").alias("text"))
    rows = judges.media_fact_checks(packages, packages, texts, quotes, evidence, evidence.where("id = 'e1'"), "k").collect()
    assert {r.check: r.details for r in rows} == {"all_claims_have_evidence": "e3", "no_source_conflicts": "e1", "original_retained_in_evidence": "e2, e3", "score_consistent_with_media": "3-0"}


def test_scenarios(spark):
    schema = "k string, expected_status string, must_pass array<string>, must_fail array<string>, expected_blocking array<string>, forbidden array<string>"
    scenarios = frame(spark, [("p", "ready", ["a"], [], [], ["GOAL"]), ("q", "needs_human_review", ["b"], ["a"], ["x"], ["goal"])], schema)
    runs = frame(spark, [("p", "ready", "pass", "pass", 7, "calm"), ("q", "ready", "fail", "pass", 3, "a Goal")], "k string, status string, facts string, quality string, angle_total int, copy string")
    checks = frame(spark, [("p", "a", "pass"), ("q", "a", "pass"), ("q", "b", "fail")], "k string, check string, result string")
    got = {r.k: (r.passed, r.failures, r.score) for r in judges.scenario_results(scenarios, runs, checks, "k").collect()}
    assert got == {"p": (True, "", 100), "q": (False, "status,not_passed:b,not_failed:a,not_blocking:x,forbidden:goal", 40)}


def test_pool_stops_at_its_cap(spark):
    rows = [("p", k, f"k{k % 40}", None, k >= 50) for k in range(60)]
    df = frame(spark, rows, "pool string, seq long, key string, title string, section boolean")
    got = [r.seq for r in ranking.first_keys(df, "pool", "seq", "key", "title", "section", pools.pool_cap()).orderBy("seq").collect()]
    assert got == [0, 1, 2, 3, 4, 5, *range(50, 60)]


def test_scenarios_judge_each_document_once(spark, small):
    from heddle.plans import catalog

    found = catalog.QUERIES["scenario_results"](spark, small)
    assert "package_exists" not in found._jdf.queryExecution().optimizedPlan().toString()
