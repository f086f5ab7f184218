"""First-wins in rounds, and the token join, against plain loops."""

import random
from collections import defaultdict

import pytest

from heddle.operators import lookup, ranking
from pyspark.sql import functions as F

SCHEMA = "pool string, seq long, key string, title string, sect boolean"


def loop(rows, cap):
    kept, keys, titles, n = [], defaultdict(set), defaultdict(set), defaultdict(int)
    for pool, seq, key, title, sect in sorted(rows, key=lambda r: (not r[4], r[1])):
        if key in keys[pool] or (title is not None and title in titles[pool]) or (cap is not None and not sect and n[pool] >= cap):
            continue
        kept.append((pool, seq, key))
        keys[pool].add(key)
        n[pool] += 1
        if title is not None:
            titles[pool].add(title)
    return sorted(kept, key=repr)


def candidates(seed, n=400):
    rng = random.Random(seed)
    seqs = rng.sample(range(10 * n), n)
    pools = ["a"] * 3 + ["b", None]
    return [(rng.choice(pools), s, rng.choice([None, *map(str, range(40))]), rng.choice([None, *map(str, range(30))]), rng.random() < 0.3) for s in seqs]


@pytest.mark.parametrize("few,rounds", [(0, 50), (0, 2), (60, 50), (10**6, 50)])
@pytest.mark.parametrize("cap", [None, 3, 20])
def test_rounds_keep_what_the_loop_keeps(spark, few, rounds, cap):
    rows = candidates(few + rounds + (cap or 0), 250)
    df = spark.createDataFrame(rows, SCHEMA)
    got = ranking.first_keys(df, "pool", "seq", "key", "title", "sect", cap, few, rounds).collect()
    assert sorted(map(tuple, got), key=repr) == loop(rows, cap)


def test_a_chain_in_which_each_row_waits_for_the_one_before(spark):
    rows = [("p", k, f"k{(k + 1) // 2}", f"t{k // 2}", False) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ranking.first_keys(df, "pool", "seq", "key", "title", None, None, 0, 3).collect()
    assert sorted(map(tuple, got), key=repr) == loop(rows, None)


def test_one_key_has_a_third_of_all_rows(spark):
    """A round is aggregations and joins: at many times the rows nothing but the few that are left goes through one task."""
    rows = spark.range(120_000).select(F.lit("p").alias("pool"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"), F.concat(F.lit("t"), F.col("id") % 7001).alias("title"))
    got = {tuple(r) for r in ranking.first_keys(rows, "pool", "seq", "key", "title", None, None, 2000).collect()}
    keys, titles, expected = set(), set(), set()
    for k in range(120_000):
        key, title = "hot" if k % 3 == 0 else f"k{k % 5000}", f"t{k % 7001}"
        if key not in keys and title not in titles:
            keys.add(key)
            titles.add(title)
            expected.add(("p", k, key))
    assert got == expected


def pairs(asked, docs, least):
    for q, words in asked.items():
        best = min(((-len(words & has), d) for d, has in docs.items() if len(words & has) >= least), default=None)
        if best is not None:
            yield q, best[1], -best[0]


@pytest.mark.parametrize("rare", [0, 3, 1000])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_token_join_equals_all_pairs(spark, rare, least):
    rng = random.Random(least)
    hot, cold = [f"hot{k}" for k in range(4)], [f"c{k}" for k in range(60)]
    some = lambda: set(rng.sample(hot, rng.randint(0, 4))) | set(rng.sample(cold, rng.randint(0, 4)))
    asked, docs = {k: some() for k in range(60)}, {k: some() for k in range(300)}
    asked[98], asked[99] = set(hot), set()
    frame = lambda rows, name: spark.createDataFrame([(k, [*v, *list(v)[:1], "x"]) for k, v in rows.items()], f"{name} long, words array<string>")
    got = lookup.resolve_tokens(frame(asked, "q"), frame(docs, "d"), F.col("words"), F.col("words"), "q", "d", least, rare)
    assert sorted(map(tuple, got.collect())) == sorted(pairs(asked, docs, least))


def test_frequent_tokens_meet_only_queries_that_need_them(spark):
    """Each doc has two tokens that all have, and each query finds more than these by its rare ones: no frequent token is joined."""
    docs = spark.range(20_000).select(F.col("id").alias("d"), F.array(F.lit("the"), F.lit("of"), *(F.concat(F.lit(f"r{j}x"), (F.col("id") / 10).cast("long")) for j in range(3))).alias("w"))
    asked = docs.where("d % 100 = 7").select(F.col("d").alias("q"), "w")
    got = lookup.resolve_tokens(asked, docs, F.col("w"), F.col("w"), "q", "d")
    assert {tuple(r) for r in got.collect()} == {(k, k // 10 * 10, 5) for k in range(7, 20_000, 100)}
