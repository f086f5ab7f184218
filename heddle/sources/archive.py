"""An archive of runs that grows: each call reads the files that none before has read.

A file stream lists ``run*.json`` below the archive's folders; its checkpoint remembers what was read, and the parquet sink's log what
was written, so a call that dies in the middle is taken up again and no file counts twice. Documents that aren't JSON are kept in a column of their own
with the file's name instead of failing the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROKEN = "_corrupt_record"


def ingest(spark: SparkSession, folder: str, store: str, schema: str | StructType, whole_files: bool = True, names: str = "run*.json", files_per_step: int = 10_000) -> None:
    """Add what is new in the archive to the store. ``whole_files``: a document a file, else a document a line."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    wanted = StructType([*kind.fields]).add(BROKEN, "string")
    reader = spark.readStream.schema(wanted).option("columnNameOfCorruptRecord", BROKEN).option("mode", "PERMISSIVE").option("multiLine", whole_files)
    found = reader.option("pathGlobFilter", names).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_step).json(folder)
    rows = found.select(*kind.fieldNames(), BROKEN, F.col("_metadata.file_path").alias("file"))
    started = rows.writeStream.format("parquet").option("path", f"{store}/runs").option("checkpointLocation", f"{store}/seen").trigger(availableNow=True).start()
    started.awaitTermination()


def runs(spark: SparkSession, store: str) -> DataFrame:
    """The documents that could be read, with their file."""
    return spark.read.parquet(f"{store}/runs").where(F.col(BROKEN).isNull()).drop(BROKEN)


def broken(spark: SparkSession, store: str) -> DataFrame:
    """(file, text) of those that could not."""
    return spark.read.parquet(f"{store}/runs").where(F.col(BROKEN).isNotNull()).select("file", F.col(BROKEN).alias("text"))


def latest(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Of each key the run with the highest seq, by aggregation."""
    last = F.max_by(F.struct(*rows.columns), seq).alias("__r")
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(last).select("__r.*")
