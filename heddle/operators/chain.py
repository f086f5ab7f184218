"""Providers that are asked in turn, each only for what those before left open."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources.sinks import materialised


@dataclass
class Provider:
    """A source of drafts. ``answer`` gets the open requests and returns drafts with their key and ``seq``; ``gate`` says of a draft why it isn't
    on what was asked for, or null; of those that pass the first by seq is taken."""

    name: str
    answer: Callable[[DataFrame], DataFrame]
    gate: Column | None = None


def resolved(asked: DataFrame, key: str, providers: list[Provider]) -> tuple[DataFrame, DataFrame]:
    """(drafts, notes) for the requests: the drafts (key, provider, draft's columns) of the first provider with one that passes its
    gate, and (key, provider, note) of every provider that was asked and gave none, in short why: "none" or the gate's reasons.

    The stages are jobs of their own: what a provider is asked is an anti-join with what is settled, cut from its lineage, so a late and dear provider sees
    few requests, and none if nothing is open."""
    left, drafts, notes = materialised(asked), None, None
    for place, provider in enumerate(providers):
        gate = provider.gate if provider.gate is not None else F.lit(None).cast("string")
        given = materialised(provider.answer(left).withColumn("__why", gate))
        passed = given.where("__why is null").drop("__why")
        first = passed.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*passed.columns), "seq").alias("__d")).select("__d.*").drop("seq")
        first = materialised(first.withColumn("provider", F.lit(provider.name)))
        rest = materialised(left.join(first.select(key), key, "left_anti"))
        why = given.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("__why")), ",").alias("note"))
        said = rest.select(key).join(why, key, "left").select(key, F.lit(place).alias("place"), F.lit(provider.name).alias("provider"), F.coalesce("note", F.lit("none")).alias("note"))
        drafts, notes = (first, said) if drafts is None else (drafts.unionByName(first), notes.unionByName(said))
        left = rest
    return drafts, notes
