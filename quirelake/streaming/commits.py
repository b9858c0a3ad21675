"""A sink that takes every batch once: data folders of their own, and a log that readers trust.

A batch is written to a folder that no other attempt uses; it counts from the moment its entry
stands in the log under the batch's number. A batch that is played again after that is left out; a
folder of an attempt that never got that far is never read. So a stream may be killed at any point
and started again, and even one that has lost its checkpoint and begins at batch 0 leaves one copy.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    """Entries ``<folder>/_log/<batch>.json``: one short JSON object each, naming the batch's data folder and rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry(self, batch: int):
        return self._path(f"{self.folder}/_log/{batch:012d}.json")

    def has(self, batch: int) -> bool:
        return self._files.exists(self._entry(batch))

    def add(self, batch: int, data: str, rows: int) -> bool:
        """Whether this attempt is the one that counts. The entry is written aside and renamed, so it is there as a whole or not at all."""
        aside = self._path(f"{self.folder}/_log/.{batch}-{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps({"batch": batch, "data": data, "rows": rows}).encode()))
        out.close()
        won = not self.has(batch) and self._files.rename(aside, self._entry(batch))
        if not won:
            self._files.delete(aside, False)
        return won

    def entries(self) -> list[dict]:
        """All entries by batch: one short object per batch is what the driver holds."""
        if not self._files.exists(self._path(f"{self.folder}/_log")):
            return []
        found = self.spark.read.schema("batch long, data string, rows long").json(f"{self.folder}/_log/*.json")
        return sorted((r.asDict() for r in found.collect()), key=lambda r: r["batch"])

    def remove(self, data: str) -> None:
        self._files.delete(self._path(f"{self.folder}/{data}"), True)

    def data_folders(self) -> list[str]:
        root = self._path(self.folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(root) if s.getPath().getName().startswith("batch-")) if self._files.exists(root) else []


def committer(folder: str):
    """A function for ``foreachBatch`` that adds every batch to ``folder`` once."""

    def write(frame: DataFrame, batch: int) -> None:
        log = CommitLog(frame.sparkSession, folder)
        if log.has(batch):
            return
        data = f"batch-{batch:012d}-{uuid.uuid4().hex}"
        frame.write.parquet(f"{log.folder}/{data}")
        rows = frame.sparkSession.read.schema(frame.schema).parquet(f"{log.folder}/{data}").count()  # from the footers alone
        if not log.add(batch, data, rows):
            log.remove(data)

    return write


def run_committed(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Take a stream to its present end; batches that the log knows already are left out."""
    from quirelake.streaming.batches import state_on_disk

    with state_on_disk(stream.sparkSession):
        running = stream.writeStream.foreachBatch(committer(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def read_committed(spark: SparkSession, folder: str, schema, up_to: int | None = None) -> DataFrame:
    """The rows of all batches in the log (up to a batch, if one is named, for a repeatable read); anything else below the folder is not looked at."""
    listed = [f"{folder.rstrip('/')}/{e['data']}" for e in CommitLog(spark, folder).entries() if e["rows"] and (up_to is None or e["batch"] <= up_to)]
    return spark.read.schema(schema).parquet(*listed) if listed else spark.createDataFrame([], schema)


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Remove the data folders that no entry names, when no stream is writing; returns their names."""
    log = CommitLog(spark, folder)
    orphans = sorted(set(log.data_folders()) - {e["data"] for e in log.entries()})
    for data in orphans:
        log.remove(data)
    return orphans
