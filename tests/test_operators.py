import json

import pytest
from pyspark.sql import functions as F

from heddle.operators import caches, evidence, health, lookup, ranking, rules
from heddle.sources import registry, sinks
from heddle.sources.tables import page_links


def events(spark, outcomes, key="a"):
    return spark.createDataFrame([(key, k, o, f"2026-07-{k + 1:02d}") for k, o in enumerate(outcomes)], "key string, seq long, outcome string, day string")


def test_streak_skips_transient(spark):
    r = health.streaks(events(spark, ["ok", "botblock", "botblock", "transient", "botblock"]), ["key"], ["seq"], "outcome", "day").first()
    assert (r.outcome, r.n, r.since) == ("botblock", 3, "2026-07-02")
    assert health.streaks(events(spark, ["botblock", "ok"]), ["key"], ["seq"], "outcome", "day").count() == 0
    assert health.streaks(events(spark, []), ["key"], ["seq"], "outcome", "day").count() == 0


def test_health_window_and_day_dedup(spark):
    kept = health.window(events(spark, ["botblock"] * 8), ["key"], ["seq"], 5)
    assert kept.count() == 5 and kept.agg(F.min("day")).first()[0] == "2026-07-04"
    same = spark.createDataFrame([("a", k, "ok", "2026-07-01") for k in range(3)], "key string, seq long, outcome string, day string")
    assert health.day_dedup(same, ["key", "outcome", "day"], ["seq"]).count() == 1


def test_schedule(spark):
    table = spark.createDataFrame([("m1", "A", "B", "2026-06-11"), ("m2", "A", "B", "2026-06-20")], "match string, pair_lo string, pair_hi string, day string").withColumn("day", F.to_date("day"))
    asked = spark.createDataFrame([(1, "A", "B", None), (2, "A", "B", "2026-06-12"), (3, "A", "B", "2026-06-13"), (4, "A", "C", None)], "k int, pair_lo string, pair_hi string, day string").withColumn("day", F.to_date("day"))
    assert {r.k: r.match for r in lookup.scheduled(asked, table, "k", "match").collect()} == {1: "m2", 2: "m1"}


def test_first_wins_keeps_the_key_of_a_dropped_title_free(spark):
    rows = [("p", 1, "k1", "a long enough title"), ("p", 2, "k2", "a long enough title"), ("p", 3, "k2", "another long title"), ("p", 4, "k1", None), ("q", 1, "k1", "a long enough title")]
    df = spark.createDataFrame(rows, "pool string, seq int, key string, title string")
    assert sorted((r.pool, r.seq) for r in ranking.first_wins(df, "pool", "seq", "key", "title").collect()) == [("p", 1), ("p", 3), ("q", 1)]


def test_corroboration_needs_different_sources(spark):
    rows = spark.createDataFrame([("m", "2-1", "x", 1), ("m", "2-1", "x", 2), ("m", "1-1", "y", 3), ("m", "1-1", "z", 4)], "k string, v string, s string, seq int")
    found = evidence.corroborated(rows, ["k"], "v", "s", F.col("seq"))
    assert [(r.v, r.sources) for r in found.collect()] == [("1-1", 2)]
    assert evidence.winner(found, ["k"], "v").first().v == "1-1"


def test_cache_and_budget(spark):
    rows = spark.createDataFrame([("a", 0, True), ("a", 9, False), ("a", 10, True)], "k string, t long, c boolean").withColumn("at", F.timestamp_seconds("t"))
    assert [r.hit for r in caches.ttl_hits(rows, ["k"], "at", "t", 10, "c").orderBy("t").collect()] == [False, True, False]
    assert [r.exceeded for r in caches.ledger(rows.withColumn("cost", F.lit(0)), ["k"], ["t"], "cost", max_calls=2).orderBy("t").collect()] == [False, False, True]


def test_missing_evidence_blocks(spark):
    rows = spark.createDataFrame([("p", False), ("q", None)], "e string, ok boolean")
    checked = rules.checks(rows, "e", {"missing_evidence": (F.col("ok"), F.lit("x"))})
    assert {r.e: (r.status, r.blocking) for r in rules.report(checked, "e").collect()} == {"p": ("needs_human_review", "missing_evidence"), "q": ("needs_human_review", "missing_evidence")}


def test_empty_summary(spark):
    r = rules.summary(spark.createDataFrame([], "x boolean"), F.col("x")).first()
    assert (r.total, r.passed, r.pass_rate) == (0, 0, 0.0)


GOOD = {"countries": [{"country": "Meksyk", "language": "es", "outlets": [{"provider_id": "RecordMX", "name": "Record", "tier": "B", "domains": ["record.com.mx"]}]}]}


@pytest.mark.parametrize(("change", "said"), [
    (lambda c: c["outlets"][0].update(tier="D"), "bad tier"), (lambda c: c["outlets"][0].update(domains=[]), "without domains"), (lambda c: c["outlets"][0].update(name=" "), "blank provider"),
    (lambda c: c["outlets"].append(dict(c["outlets"][0])), "provider twice"), (lambda c: c.update(country=" "), "blank country"), (lambda c: c["outlets"][0].update(provider_id="OfficialMatchApi"), "reserved"),
])
def test_registry_is_strict(spark, tmp_path, change, said):
    good = json.loads(json.dumps(GOOD))
    change(good["countries"][0])
    (tmp_path / "r.json").write_text(json.dumps(good))
    with pytest.raises(registry.RegistryError, match=said):
        registry.read_registry(spark, str(tmp_path / "r.json"))


def test_registry_reads(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(GOOD))
    countries, outlets = registry.read_registry(spark, str(tmp_path / "r.json"))
    assert countries.count() == 1 and (outlets.first().confidence, outlets.first().language) == ("high", "es")
    with pytest.raises(registry.RegistryError):
        registry.read_registry(spark, str(tmp_path / "none.json"))


def test_schedule_is_lenient(spark, tmp_path):
    assert registry.read_schedule(spark, str(tmp_path / "none.json")).count() == 0
    rows = {"competition": "WC", "matches": [{"date": "2026-06-11", "home": "A", "away": "B", "city": "X", "stadium": "", "stage": "g"}, {"home": "A", "away": "B"}]}
    (tmp_path / "s.json").write_text(json.dumps(rows))
    r = registry.read_schedule(spark, str(tmp_path / "s.json")).collect()
    assert [(x.competition, x.venue) for x in r] == [("WC", "X")]


def test_runs_and_upserts(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "ready"), ("r2", "review")], "run_id string, status string")
    sinks.save_runs(runs, str(tmp_path / "runs"))
    sinks.save_runs(runs.where("run_id = 'r2'").withColumn("status", F.lit("ready")), str(tmp_path / "runs"))
    back = spark.read.json(str(tmp_path / "runs"))
    assert sorted((r.run_id, r.status) for r in back.collect()) == [("r1", "ready"), ("r2", "ready")]
    assert registry.latest_run(back.select("run_id", "status")).first().run_id == "r2"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, seq int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"], "seq").collect()) == [("a", 2, "z"), ("b", 1, "y")]


def test_staged_search(spark, tmp_path):
    from heddle.sources.search import StagedSearch

    hits = [{"url": "https://www.a.example/x", "title": "t"}, {"url": "https://b.test/x"}]
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, hits)))
    spark.dataSource.register(StagedSearch)
    found = spark.read.format("staged_search").option("path", str(tmp_path)).option("domains", "a.example").load()
    assert [(r.url, r.title, r.snippet) for r in found.collect()] == [("https://www.a.example/x", "t", None)]


def test_links(spark):
    html = '<a  class="x" href="/p?q=1">One <b>two</b></a><a href="#x">no</a><A HREF=\'b.html\'>c</A><a href="mailto:x">m</a><a href="//h.example/y">z</a>'
    rows = spark.createDataFrame([(1, "https://a.example/d/e?x", html), (2, None, None)], "page_id int, url string, html string")
    assert [(r.position, r.href, r.anchor) for r in page_links(rows).orderBy("position").collect()] == [(0, "https://a.example/p?q=1", "One two"), (1, "https://a.example/d/b.html", "c"), (2, "https://h.example/y", "z")]


def test_small_assembly_functions(spark, column):
    from heddle.operators import assembly, pipelines

    assert column(pipelines.last_sentence, "One ended. Two began! Was it luck?") == "Was it luck?"
    assert column(pipelines.last_sentence, "No question. Here.") is None
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"], "E"), (2, ["a"], None)], "k int, names array<string>, english string")
    got = {r.k: r.n for r in df.select("k", assembly.hashtag_names(F.col("names"), F.col("english")).alias("n")).collect()}
    assert got == {1: ["E", "c", "d"], 2: []}
    q = lambda h: column(lambda x: assembly.title_question(x, F.lit("Mexico"), F.lit("RPA")), h)
    assert q("Mexico 2:1 RPA. was it luck?") == "Was it luck?"
    assert q("Mexico 2-1: how?") == "How?"
    assert q("Nothing: here") == "Nothing: here"
    assert column(assembly.capitalised, "iPhone") == "iPhone" and column(assembly.capitalised, "a") == "A" and column(assembly.capitalised, "") == ""


def test_dimension_files(spark, tmp_path):
    assert [r.provider_id for r in registry.providers_with(registry.infrastructure(spark), "facts").collect()] == ["OfficialMatchApi", "OfflineVerifiedFixture"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"match_id": "a",\n "aliases": ["x"]}')
    (tmp_path / "m" / "_template.json").write_text('{"match_id": "t"}')
    assert [(r.match_id, r.file) for r in registry.read_matches(spark, str(tmp_path / "m")).collect()] == [("a", "a.json")]
    (tmp_path / "flags.json").write_text('{"country": "A", "iso2": "mx"}\n{"country": "B", "iso2": "M1"}')
    pattern = "^[a-z]{2}(-[a-z]{3})?$"
    assert [r.country for r in registry.lookup_map(spark, str(tmp_path / "flags.json"), "country", "iso2", pattern).collect()] == ["A"]
    assert registry.lookup_map(spark, str(tmp_path / "none.json"), "country", "iso2").count() == 0


def test_archived_runs_skip_broken_files(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "run.json").write_text('{"run_id": "r%d",\n "status": "ready"}' % k if k == 1 else '{"run_id": ')
    assert [r.run_id for r in registry.read_runs(spark, str(tmp_path)).select("run_id").collect()] == ["r1"]


def test_expired_cache_entries(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 5)], "k string, t long").withColumn("at", F.timestamp_seconds("t"))
    left = sinks.unexpired(rows, F.col("at"), F.lit(10), F.timestamp_seconds(F.lit(10)))
    assert [r.k for r in left.collect()] == ["b"]
    assert [json.loads(r.json) for r in sinks.json_rows(left.select("k")).collect()] == [{"k": "b"}]
