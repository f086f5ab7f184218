"""Connected components of a large edge list by star contraction.

Each round hangs every node's larger neighbours below its smallest one (large star), then every
node's smaller neighbours and the node below the smallest (small star). It ends when each node
hangs below one root directly. All rounds are joins and aggregations over the edges, written to
the shared checkpoint folder; nothing but one boolean a round comes to the driver. A hub's edges
meet only in joins, whose large partitions Spark splits, and in minima, which combine on the map
side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise

MAX_ROUNDS = 60


def _is_flat(edges: DataFrame) -> bool:
    """Whether each node is below one other at most, and none that is below another is above one."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(edges.select(F.col("lo"), F.lit(0), F.lit(1)))
    per = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    bad = F.coalesce(F.max((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))), F.lit(False))
    return not per.agg(bad.alias("bad")).first()["bad"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b, any order, repeats allowed) that are not
    their component's smallest node; label is that smallest node. Edges with a null end or
    from a node to itself link nothing."""
    a, b = F.col("a"), F.col("b")
    edges = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = materialise(edges)
    for _ in range(MAX_ROUNDS):
        if _is_flat(edges):
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialise(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
