"""Time-to-live caches and call budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.fixed import MAX_CALLS


def ttl_hits(rows: DataFrame, key: list[str], at: str, seq: str, seconds: int, cacheable: str) -> DataFrame:
    """Rows with hit: whether the key's last cacheable row before is younger than the time to live.
    Empty results and errors are never cached; at the time of expiry it is a miss."""
    before = Window.partitionBy(*key).orderBy(at, seq).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(cacheable), F.col(at)), ignorenulls=True).over(before)
    return rows.withColumn("hit", F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) < F.unix_micros(last.cast("timestamp")) + seconds * 1_000_000, F.lit(False)))


def ledger(rows: DataFrame, key: list[str], order: list[str], cost: str, max_calls: int = MAX_CALLS, max_cost: float | None = None) -> DataFrame:
    """Rows with running calls and cost, and whether a limit is exceeded (reaching it isn't)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("calls", F.count("*").over(w)).withColumn("spent", F.sum(cost).over(w))
    over = F.col("calls") > max_calls
    return counted.withColumn("exceeded", over | (F.col("spent") > max_cost) if max_cost is not None else over)
