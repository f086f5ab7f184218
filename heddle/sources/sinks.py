"""Sinks: run documents, keyed upserts, texts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which all executors share; a
    temporary one only where that is unset and all runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="heddle-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: it is computed once, and what follows does not depend on executors that are lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def save_runs(runs: DataFrame, folder: str, key: str = "run_id") -> None:
    """One folder of JSON for each run; a run that is written again replaces its own only."""
    conf = runs.sparkSession.conf
    before = conf.get("spark.sql.sources.partitionOverwriteMode")
    conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        runs.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).json(folder)
    finally:
        conf.set("spark.sql.sources.partitionOverwriteMode", before)


def upsert(old: DataFrame | None, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The rows of both, of each key the one with the highest seq. Write it to a new folder: a
    reader then sees the old state or the new one, never a half."""
    both = new if old is None else old.unionByName(new)
    last = F.max_by(F.struct(*both.columns), seq).alias("__r")
    return both.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(last).select("__r.*")


def unexpired(rows: DataFrame, at: Column, seconds: Column, now: Column) -> DataFrame:
    """Cache entries that are still valid; at the time of expiry they aren't."""
    return rows.where(F.unix_micros(now) < F.unix_micros(at) + seconds * 1_000_000)


def save_texts(rows: DataFrame, text: str, folder: str) -> None:
    rows.select(F.col(text).alias("value")).write.mode("overwrite").text(folder)


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON string a row, null fields left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
