"""Streams of files in bounded batches, and running them to their end."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on local disk, as keyed processors need; the session is left as it was."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ON_DISK)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def file_stream(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """Parquet files below ``path`` as a stream; a batch takes ``most_files`` at most, so a slow consumer is never flooded."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.parquet(f"{path}*")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Everything that a stream gives up to its present end, written below ``folder`` batch by batch and read back.

    An interrupted run goes on where its checkpoint ends.
    """
    with state_on_disk(stream.sparkSession):
        running = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def kept_running(stream: DataFrame, folder: str, seconds: float = 1.0):
    """The same as a query that goes on, with a batch every ``seconds`` for whatever has arrived; returns its handle."""
    with state_on_disk(stream.sparkSession):
        return stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(processingTime=f"{seconds} seconds").start()
