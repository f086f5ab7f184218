"""Stable orders, first-wins dedup, prefix limits. Every order ends in a key that is unique."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.fixed import THIN_BODY
from heddle.sources.sinks import materialised


def first_of(rows: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The first row of each key, by aggregation."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*seq)).alias("__first")
    return rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key))).agg(first).select("__first.*")


def top_per(rows: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark keeps n rows of a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(name, rank.cast("long")).where(F.col(name) <= n)


def title_key(title: Column, least: int = 12) -> Column:
    """Lower-case title with single spaces, null if it is too short to tell articles apart."""
    t = F.btrim(F.regexp_replace(F.lower(title), r"\s+", " "))
    return F.when(F.length(t) >= least, t)


#: Candidates in all from which pools are settled in rounds, and how often; the rest, and fewer, walk pool by pool.
FEW, ROUNDS = 200_000, 24


def _walk(rows: DataFrame, pool: str, key: str, title: str, cap: int | None) -> DataFrame:
    """Of (pool, key, title, at) those that repeat neither, in the order of at: a pool streams through one task, which
    remembers the keys and titles of the rows that it keeps."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [pool, key, title, "at"]
    dealt = rows.select(*names).repartition(partitions, pool).sortWithinPartitions(pool, "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, keys, titles = (), set(), set()
        for batch in batches:
            kept = []
            for p, k, t, at in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (p,) != of:
                    of, keys, titles = (p,), set(), set()
                full = cap is not None and at["later"] and len(keys) >= cap
                kept.append(not (full or k in keys or (t is not None and t in titles)))
                if kept[-1]:
                    keys.add(k)
                    titles.update(() if t is None else (t,))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return dealt.mapInArrow(walk, dealt.schema)


def _round(left: DataFrame, pool: str, key: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(kept, still open): a row that is the first of both its key and its title is kept; rows that share one with it go."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    first = lambda by, names: left.groupBy(F.col(pool).alias(names[0]), F.col(by).alias(names[1])).agg(F.min("at").alias(names[2]))
    keys, titles = first(key, ["__p1", "__k", "__by_key"]), first(title, ["__p2", "__t", "__by_title"]).where("__t is not null")
    met = left.join(keys, same(pool, "__p1") & same(key, "__k")).join(titles, same(pool, "__p2") & (F.col(title) == F.col("__t")), "left")
    wins = (F.col("at") == F.col("__by_key")) & (F.col("at") == F.coalesce("__by_title", "at"))
    names = [pool, key, title, "at"]
    met = materialised(met.select(*names, wins.alias("wins")))
    kept = met.where("wins").select(*names)
    taken = lambda by, names: kept.select(F.col(pool).alias(names[0]), F.col(by).alias(names[1]))
    rest = met.where(~F.col("wins")).join(taken(key, ["__p1", "__k"]), same(pool, "__p1") & same(key, "__k"), "left_anti")
    rest = rest.join(taken(title, ["__p2", "__t"]), same(pool, "__p2") & (F.col(title) == F.col("__t")), "left_anti")
    return kept, materialised(rest.select(*names))


def first_keys(
    rows: DataFrame, pool: str, seq: str, key: str, title: str, ahead: str | None = None, cap: int | None = None, few: int = FEW, rounds: int = ROUNDS
) -> DataFrame:
    """(pool, seq, key) of the candidates of each pool that repeat neither a key nor a title of one that is kept
    before. In the order of seq, those with ``ahead`` first: a known key drops a row; so does a known title (null
    is none), and then the row's key stays free. With ``cap``, rows that aren't ahead are kept only while
    fewer are.

    Of equal key and title only the first can be kept, so an aggregation leaves no others. What remains is a graph
    whose rows join keys with titles, and the rows that are kept are its greedy matching. It is found in rounds of
    aggregations and joins: a row that is the first of its key and of its title is kept whatever comes before
    it, and all that share either are settled. Once ``few`` rows are open, or after ``rounds``, for chains in which each
    row waits for the one before, the rest walks in order, a pool in a task. The cap only ends each pool's kept rows."""
    later = ~F.col(ahead) if ahead else F.lit(True)
    narrow = rows.groupBy(pool, key, title, later.alias("__later")).agg(F.min(seq).alias("__seq"))
    left = materialised(narrow.select(pool, key, title, F.struct(F.col("__later").alias("later"), F.col("__seq").alias("seq")).alias("at")))
    kept = []
    while len(kept) < rounds and left.limit(few + 1).count() > few:
        won, left = _round(left, pool, key, title)
        kept.append(won)
    chosen = _walk(left, pool, key, title, cap)
    for won in kept:
        chosen = chosen.unionByName(won)
    chosen = chosen.select(pool, F.col("at.seq").alias(seq), key, F.col("at.later").alias("__later"))
    if cap is not None and kept:
        before = chosen.groupBy(F.col(pool).alias("__pool")).agg(F.count_if(~F.col("__later")).alias("__ahead"))
        order = [F.col("__later"), F.col(seq)]
        some = top_per(chosen.where("__later"), [pool], order, cap, "__nth")
        some = some.join(before, F.col(pool).eqNullSafe(F.col("__pool"))).where(F.col("__nth") + F.col("__ahead") <= cap)
        chosen = chosen.where("not __later").unionAll(some.select(*chosen.columns))
    return chosen.select(pool, seq, key)


def first_wins(rows: DataFrame, pool: str, seq: str, key: str, title: str) -> DataFrame:
    """The rows that ``first_keys`` names; seq is unique in a pool."""
    chosen = first_keys(rows, pool, seq, key, title).select(F.col(pool).alias("__pool"), F.col(seq).alias("__seq"))
    same = rows[pool].eqNullSafe(F.col("__pool")) & (rows[seq] == F.col("__seq"))
    return rows.join(chosen, same, "left_semi")


def opinions_first(rows: DataFrame, group: str, is_opinion: Column, seq: str) -> DataFrame:
    """One report, then all opinions, then the other reports; without opinions the order as is."""
    w = Window.partitionBy(group)
    nth = F.row_number().over(Window.partitionBy(group, "__opinion").orderBy(seq))
    rows = rows.withColumn("__opinion", is_opinion).withColumn("__any", F.max("__opinion").over(w)).withColumn("__nth", nth)
    bucket = F.when(~F.col("__any"), 0).when(~F.col("__opinion") & (F.col("__nth") == 1), 0).when(F.col("__opinion"), 1).otherwise(2)
    place = F.row_number().over(w.orderBy(bucket, seq)).cast("long")
    return rows.withColumn("place", place).drop("__opinion", "__any", "__nth")


def demoted(rows: DataFrame, group: str, bad: Column, seq: str) -> DataFrame:
    """Stable partition: the good ones keep their order, then the bad ones theirs."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(bad.cast("int"), seq)).cast("long")
    return rows.withColumn("place", place)


def full_first(rows: DataFrame, group: str, body: Column, seq: str, n: int = 2) -> DataFrame:
    """Up to n rows of a group: those with a full body, thin ones only to fill up."""
    thin = F.coalesce(F.length(body) < THIN_BODY, F.lit(True)).cast("int")
    return top_per(rows.withColumn("thin", thin), [group], [F.col("thin"), F.col(seq)], n)


def pool_order(seq: str) -> list[Column]:
    """Media pool: later than the match, own reaction, sports section, more aliases, earlier."""
    return [F.col("prematch"), F.col("non_reaction"), F.col("other_section"), F.col("relevance").desc(), F.col(seq)]


def facts_order(seq: str) -> list[Column]:
    """Facts pool: a score in the slug, later than the match, no roundup, more aliases, earlier."""
    return [~F.col("has_score"), F.col("prematch"), F.col("roundup"), F.col("relevance").desc(), F.col(seq)]


def relevance(blob: Column, tokens: tuple[str, ...]) -> Column:
    """How many different alias tokens the text has."""
    found = F.lit(0)
    for t in tokens:
        found = found + F.contains(blob, F.lit(t)).cast("int")
    return F.coalesce(found, F.lit(0))
