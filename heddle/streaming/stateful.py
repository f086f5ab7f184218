"""What keyed state of a stream with timers or lists needs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.encodingFormat": "avro",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start streams with lists, timers or time to live in their state within this. Such state is kept in RocksDB, on each executor and in the
    query's checkpoint; Avro lets a later version of a query add fields to it. A query takes the settings with it when it starts, so those of
    the session are put back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(rows: DataFrame, folder: str) -> None:
    """Run the stream over all that is there, from where its checkpoint in the folder left off, and add its rows to the folder's table."""
    with keyed_state(rows.sparkSession):
        started = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
