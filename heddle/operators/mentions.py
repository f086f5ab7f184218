"""Names of a large dictionary in texts: one automaton of all aliases, built once in each Python worker."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Aliases that one automaton has. More are dealt out over several passes, so what a worker holds is bounded.
MAX_ALIASES = 200_000
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

_built: dict[str, object] = {}


def _automaton(name: str, shared):
    """This worker's automaton of a broadcast list of aliases; only the last one is kept."""
    if name not in _built:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for alias in shared.value:
            automaton.add_word(alias, alias)
        automaton.make_automaton()
        _built.clear()
        _built[name] = automaton
    return _built[name]


def _found(automaton, text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, alias) of the aliases that are no parts of longer words."""
    for last, alias in automaton.iter(text):
        start, end = last - len(alias) + 1, last + 1
        if not ((start and text[start - 1] in WORD) or (end < len(text) and text[end] in WORD)):
            yield start, end, alias


def settled(found: list[tuple[int, int, str]]) -> dict[str, int]:
    """Where each alias first is, of those that count: from left to right, the longest at a place, none within another."""
    first: dict[str, int] = {}
    upto = 0
    for start, end, alias in sorted(found, key=lambda m: (m[0], -m[1])):
        if start >= upto:
            upto = end
            first.setdefault(alias, start)
    return first


def _pass(rows: DataFrame, key: str, aliases: list[str], alone: bool) -> DataFrame:
    """(key, start, end, alias) of all matches, or, where there is no other pass, of those that count."""
    shared, name = rows.sparkSession.sparkContext.broadcast(aliases), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared)
        for batch in batches:
            at, starts, ends, names = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                matches = list(_found(automaton, text or "")) if len(automaton) else []
                for start, end, alias in [(s, s + len(a), a) for a, s in settled(matches).items()] if alone else matches:
                    at.append(k)
                    starts.append(start)
                    ends.append(end)
                    names.append(alias)
            yield pa.record_batch([batch.column(key).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(names, pa.string())], [key, "start", "end", "alias"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, start long, end long, alias string")


def _settle(found: DataFrame, key: str) -> DataFrame:
    """The matches of several passes that count; those of one text meet in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, names = [], [], []
            for k, matches in enumerate(batch.column("m").to_pylist()):
                for alias, start in settled([(m["start"], m["end"], m["alias"]) for m in matches]).items():
                    at.append(k)
                    starts.append(start)
                    names.append(alias)
            yield pa.record_batch([batch.column(key).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(names, pa.string())], [key, "start", "alias"])

    per = found.groupBy(key).agg(F.collect_list(F.struct("start", "end", "alias")).alias("m"))
    return per.mapInArrow(run, f"`{key}` {found.schema[key].dataType.simpleString()}, start long, alias string")


def mentions(rows: DataFrame, aliases: DataFrame, key: str, text: str, most: int = MAX_ALIASES) -> DataFrame:
    """(key, name, position): the names whose aliases (alias, name) a text has as whole words, by where they first are. Texts and aliases are folded before, keys
    are unique. From left to right the longest alias at a place counts, and what it covers holds no other; an alias of several
    names counts for each.

    Aliases come to the driver ``most`` at a time and go once to every executor. The matches of several passes meet again by text."""
    clean = aliases.where(F.coalesce(F.col("alias"), F.lit("")) != "")
    parts = max(1, -(-clean.count() // most))
    narrow = rows.select(key, F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = None
    for k in range(parts):
        some = clean.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == k).select("alias").distinct()
        here = _pass(narrow, key, [r["alias"] for r in some.collect()], parts == 1)  # about ``most`` of them
        found = here if found is None else found.unionAll(here)
    kept = (found if parts == 1 else _settle(found, key)).select(key, "start", "alias")
    named = kept.join(clean.select("alias", "name").distinct(), "alias").groupBy(key, "name").agg(F.min("start").alias("at"))
    return named.select(key, "name", F.row_number().over(Window.partitionBy(key).orderBy("at", "name")).cast("long").alias("position"))
