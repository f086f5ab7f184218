"""The dictionary of names against a regular expression; collecting against loops."""

import random
import re

import pytest

from heddle.operators import collect, mentions
from pyspark.sql import functions as F


def plain(text, names):
    found, pattern = {}, "(?<![a-z0-9])(" + "|".join(re.escape(a) for a in sorted(names, key=lambda a: (-len(a), a))) + ")(?![a-z0-9])"
    for m in re.finditer(pattern, text or ""):
        for name in names[m[1]]:
            found.setdefault(name, m.start())
    return [n for n, _ in sorted(found.items(), key=lambda x: (x[1], x[0]))]


@pytest.mark.parametrize("most", [4, 1000])
def test_mentions_equal_one_pattern(spark, most):
    rng = random.Random(most)
    word = lambda: rng.choice(["ab", "a", "abc", "b", "new", "york", "é", "x1"])
    names = {}
    for _ in range(25):
        names.setdefault(rng.choice([" ", "-"]).join(word() for _ in range(rng.randint(1, 3))), set()).add(f"n{rng.randint(0, 15)}")
    texts = [rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, "", "abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    aliases = spark.createDataFrame([(a, n) for a, ns in names.items() for n in ns] + [(None, "x"), ("", "y")], "alias string, name string")
    got = {}
    for r in mentions.mentions(rows, aliases, "k", "text", most).orderBy("k", "position").collect():
        got.setdefault(r.k, []).append(r.name)
    assert got == {k: p for k, t in enumerate(texts) if (p := plain(t, names))}


def test_a_hundred_thousand_aliases(spark):
    aliases = spark.range(100_000).select(F.concat(F.lit("name "), F.col("id"), F.lit(" of it")).alias("alias"), F.col("id").cast("string").alias("name"))
    rows = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("say name "), F.col("id") * 37, F.lit(" of it, and name "), F.col("id"), F.lit(" of item")).alias("text"))
    got = {r.k: r.name for r in mentions.mentions(rows, aliases, "k", "text").collect()}
    assert got == {k: str(37 * k) for k in range(2000)}
    none = mentions.mentions(rows, aliases.where("alias is null"), "k", "text")
    assert none.count() == 0


def test_first_query_with_articles_of_the_domains(spark):
    article = "https://www.a.example/sport/a-long-slug-of-words-"
    rows = [(1, 0, 1, "https://www.a.example/tag"), (1, 0, 2, article.replace("a.example", "b.example") + "1"), (1, 1, 3, article + "1"), (1, 1, 4, article + "1"), (1, 2, 5, article + "2"), (2, 0, 6, article + "3")]
    domains = F.when(F.col("request") == 1, F.array(F.lit("a.example"))).otherwise(F.array().cast("array<string>"))
    hits = spark.createDataFrame(rows, "request long, query int, seq long, url string").withColumn("domains", domains)
    assert sorted(r.seq for r in collect.first_answered(hits, "request", "query", "domains").collect()) == [3, 4]
    chosen, notes = collect.facts(hits, "request", "query", "seq", "domains", F.when(F.col("seq") != 3, F.lit("t")), F.lit(None).cast("string"))
    assert [(r.request, r.seq, r.text) for r in chosen.collect()] == [(1, 4, "t")] and notes.count() == 0
    _, notes = collect.facts(hits, "request", "query", "seq", "domains", F.when(F.col("seq") != 3, F.lit("t")), F.lit("teams"))
    assert [tuple(r) for r in notes.collect()] == [(1, 2, 1, "teams")]


def test_articles_of_a_country(spark):
    full, thin = "w" * 900, "w" * 899
    rows = [
        ("A", 1, "o", thin, True, True), ("A", 2, "o", full, True, True), ("A", 3, "o", full, True, False), ("A", 4, None, full, True, True), ("A", 5, "o", full, True, True), ("A", 6, "o", full, True, True),
        ("B", 1, "o", full, True, True), ("B", 2, "o", thin, True, True), ("B", 3, "o", thin, True, True), ("B", 4, "o", "It was 2-1.", False, True),
        ("C", 1, "o", "They drew 1-1.", False, True), ("C", 2, "o", "It was 1-2.", False, False), ("C", 3, "o", "It was 2-1.", None, True), ("D", 1, "o", "nothing", False, True),
    ]
    hits = spark.createDataFrame(rows, "g string, seq long, provider_id string, text string, played boolean, quoted boolean")
    got = collect.articles(hits, "g", "seq", "text", F.col("played"), F.col("quoted"), F.lit("2"), F.lit("1"))
    assert sorted(tuple(r) for r in got.collect()) == [("A", 2, False, False, 1), ("A", 5, False, False, 2), ("B", 1, False, False, 1), ("B", 2, True, False, 2), ("C", 2, True, True, 1)]
    body = lambda *a: spark.range(1).select(collect.body(*(F.lit(x) for x in a))).first()[0]
    assert (body("page", "index text", False), body("the page", "index", False), body("longer page text", "index", True), body("page", None, True), body("same", "text", False)) == ("index text", "the page", "index", "page", "same")
