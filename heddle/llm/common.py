"""What the training-data operators share: reading, batch sizes, checkpoints, worker set-up."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes in one Arrow batch. Whole texts travel in them, so they bound a Python worker's memory; a
#: longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for tables of long texts. Spark reads these settings when a plan
    runs, which is after the operator has returned, so they stay set for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, cutting its lineage.

    The folder is what ``spark.checkpoint.dir`` names. Only where that is unset and all runs in one
    process, as in tests, a temporary one is used. Spark removes the files when nothing refers to
    them any more if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="heddle-checkpoint-"))
    return df.checkpoint()


def single_threaded() -> None:
    """Tokenizer libraries start a thread pool a process; an executor core has one process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function that is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield one(batch)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def filled(name: str = "text"):
    """The text column, null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")
