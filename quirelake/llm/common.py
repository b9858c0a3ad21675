"""Helpers that the corpus operators share: durable intermediates and base columns."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.session import shared_dir

#: Rows of one Arrow batch where rows are whole texts; Spark's own default is ten times as many.
TEXT_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts travel to Python in smaller batches from here on, which both the JVM and the workers hold whole."""
    if not 0 < int(spark.conf.get(_ROWS)) <= TEXT_ROWS:
        spark.conf.set(_ROWS, str(TEXT_ROWS))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; removed when Python ends."""
    path = f"{shared_dir(spark)}/quirelake/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage durably: a lost executor costs only its running tasks. ``free`` has the
    driver collect its garbage, so that Spark removes the shuffle files that led here.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if free:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the written table that ``df`` reads, once its successor is written."""
    root = f"{shared_dir(df.sparkSession)}/quirelake/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quirelake/" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            _remove(df.sparkSession, folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator works on, whatever else the table carries."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def boxed(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns inside one column ``row``, so that none can clash; doc_id and text beside it."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
