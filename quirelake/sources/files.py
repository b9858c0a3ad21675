"""File inputs: listing, filters, resumption, text artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.text import INPUT_SUFFIXES
from quirelake.session import exists


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """path, name, stem, suffix, length of supported files, not below subfolders. Contents are not read."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    named = found.withColumn("name", F.regexp_extract("path", r"([^/]+)\z", 1))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)\z", 1))
    return named.withColumns({"suffix": suffix, "stem": F.regexp_replace("name", r"\.[^.]+\z", "")}).where(F.col("suffix").isin(*INPUT_SUFFIXES)).orderBy("path")


def pending(documents: DataFrame, done: DataFrame, on: str = "name") -> DataFrame:
    """Documents without a finished artifact of the same name."""
    return documents.join(done.select(on).distinct(), on, "left_anti")


def pages_of(documents: DataFrame) -> DataFrame:
    """One row per page: page_idx from 0, page_num from 1, and the cached page's file name."""
    page = documents.where("page_count > 0").withColumn("page_idx", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)))
    return page.withColumns({"page_num": F.col("page_idx") + 1, "cache_name": F.format_string("page_%03d.png", F.col("page_idx") + 1)})


def write_markdown(pages: DataFrame, folder: str) -> None:
    """The Markdown of every document (columns stem, markdown) in a bounded number of files below ``folder``, ranges of stems in order."""
    told = pages.select(F.col("stem").cast("string").alias("stem"), F.col("markdown").alias("value"))
    told.repartitionByRange("stem").sortWithinPartitions("stem").write.mode("overwrite").parquet(folder)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """stem, value by stem; no row where nothing was written."""
    kind = "stem string, value string"
    return spark.read.schema(kind).parquet(folder).orderBy("stem") if exists(spark, folder) else spark.createDataFrame([], kind)


def read_listed(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """path, value of the text files below ``folder`` that the manifest (path, relative) names, sorted; others are not read."""
    root = folder.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", r"^.*?" + _quoted(root.split("://")[-1].lstrip("/")) + "/", "")
    listed = found.withColumn("path", relative).join(manifest.select("path").distinct(), "path")
    return listed.select("path", F.decode("content", "UTF-8").alias("value")).orderBy("path")


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def with_cached_pages(pages: DataFrame, cached: DataFrame, skip_processed: bool) -> DataFrame:
    """Adds reused to pages: whether a cached image (doc_id, page_idx) stands for one; only where finished work is skipped."""
    if not skip_processed:
        return pages.withColumn("reused", F.lit(False))
    known = cached.select("doc_id", "page_idx").distinct().withColumn("reused", F.lit(True))
    return pages.join(known, ["doc_id", "page_idx"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
