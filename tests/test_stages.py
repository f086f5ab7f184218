"""Joins by day, chains of providers and section pages, against plain loops."""

import datetime
import random

from heddle.operators import chain, lookup, sections
from pyspark.sql import functions as F


def test_days_are_part_of_the_join_key(spark):
    rng = random.Random(1)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    schedule = [(m, *sorted(rng.sample("abc", 2)), day(rng.randrange(40))) for m in range(80)]
    asked = [(k, *sorted(rng.sample("abcd", 2)), rng.choice([None, day(rng.randrange(44))])) for k in range(200)]
    expected = {}
    for key, lo, hi, want in asked:
        met = [(want is not None and d == want, d, m) for m, a, b, d in schedule if (a, b) == (lo, hi) and (want is None or abs((d - want).days) <= 1)]
        if met:
            expected[key] = max(met)[2]
    left = spark.createDataFrame(asked, "k long, pair_lo string, pair_hi string, day date")
    right = spark.createDataFrame(schedule, "m long, pair_lo string, pair_hi string, day date")
    assert {r.k: r.m for r in lookup.scheduled(left, right, "k", "m").collect()} == expected


def test_a_pair_with_a_long_history_is_not_looked_through(spark):
    """100 times the days of one pair: the join gives a row for each day that is asked for, not for each in its history."""
    history = spark.range(200_000).select(F.col("id").alias("m"), F.lit("a").alias("pair_lo"), F.lit("b").alias("pair_hi"), F.expr("date_add(date'1000-01-01', cast(id as int))").alias("day"))
    asked = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("pair_lo"), F.lit("b").alias("pair_hi"), F.when(F.col("id") % 50 > 0, F.expr("date_add(date'1000-01-01', cast(id * 300 as int))")).alias("day"))
    found = {r.k: r.m for r in lookup.scheduled(asked, history, "k", "m").collect()}
    assert found == {k: k * 300 if k % 50 else 199_999 for k in range(500)}


def test_later_providers_are_asked_only_for_what_is_open(spark):
    asked = spark.createDataFrame([(k, f"d{k}") for k in range(10)], "request long, want string")
    seen = []

    def provider(name, drafts):
        table = spark.createDataFrame(drafts, "request long, seq long, day string")

        def answer(left):
            seen.append((name, sorted(r.request for r in left.collect())))
            return table.join(left, "request")

        return chain.Provider(name, answer, F.when(F.col("day") != F.col("want"), "day"))

    first = provider("first", [(0, 2, "d0"), (0, 1, "x"), (0, 3, "d0"), (1, 1, "no"), (99, 1, "d99")])
    second = provider("second", [(k, 1, f"d{k}") for k in range(1, 9)])
    drafts, notes = chain.resolved(asked, "request", [first, second, provider("third", [(9, 1, "bad"), (5, 1, "d5")])])
    assert sorted((r.request, r.provider, r.day) for r in drafts.collect()) == [(0, "first", "d0"), *((k, "second", f"d{k}") for k in range(1, 9))]
    assert seen == [("first", list(range(10))), ("second", list(range(1, 10))), ("third", [9])]
    said = {(r.request, r.provider): r.note for r in notes.collect()}
    assert said[1, "first"] == "day" and said[9, "second"] == "none" and said[9, "third"] == "day" and (0, "first") not in said and len(said) == 11


def test_section_links(spark):
    names = "country string, section string, idx long, dead boolean, last_probe string, domains array<string>"
    pages = [("C", "s1", 1, False, None, ["a.example"]), ("C", "s2", 2, True, None, ["a.example"]), ("C", "s3", 3, False, None, ["b.example"]), ("D", "s9", 1, False, None, [])]
    article = "https://www.a.example/sport/a-long-slug-of-words-here-"
    links = [
        ("s1", 0, article + "1", "Other news"),  # an article that is not on the match doesn't take the key
        ("s1", 1, article + "1", "Opponentia sank us"),
        ("s1", 2, article + "2", "Ownland: reakcje"),
        ("s1", 3, article + "3", "Ownland reakcjeX"),
        ("s1", 4, "https://evil.example/sport/a-long-slug-of-words-here-4", "Opponentia"),
        ("s1", 5, "https://www.a.example/tag/", "Opponentia"),
        ("s3", 0, "https://b.example/sport/a-long-slug-of-words-here-5", "nothing"),
        ("s2", 0, article + "1", "Opponentia again"),
        ("s9", 0, article + "9", "Opponentia"),
    ]
    profile = spark.createDataFrame([("C", ["Opponentia", "OP"], ["Ownland", "OL"], ["{team} reakcje", "po {opponent}"], "Mundial-26"), ("D", [], ["Ownland"], [], None)], "country string, opponent array<string>, own array<string>, templates array<string>, event string")
    words = sections.reaction_words(F.col("templates"), F.col("event"), F.col("own"))
    profile = profile.select("country", sections.names_to_find(F.col("opponent")).alias("opponent"), sections.names_to_find(F.col("own")).alias("own"), words.alias("words"))
    assert {r.country: sorted(r.words) for r in profile.collect()} == {"C": ["26", "mundial", "reakcje"], "D": []}
    hits, probes = sections.section_hits(spark.createDataFrame(pages, names), spark.createDataFrame(links, "section string, position long, href string, anchor string"), profile, 2)
    assert sorted((r.country, r.section, r.position, r.title) for r in hits.collect()) == [("C", "s1", 1, "Opponentia sank us"), ("C", "s1", 2, "Ownland: reakcje")]
    got = sorted((r.country, r.section, r.place, r.article_links, r.links_found, r.outcome) for r in probes.collect())
    # the dead section may be asked again: of three the second place explores
    assert [g[:1] + g[3:] for g in got if g[1] == "s1"] == [("C", 4, 2, "links")] and ("D", "s9", 1, 1, 0, "links") in got and len(got) == 3
