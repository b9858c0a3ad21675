"""Result records of documents: writing them, one by one or together, and reading them back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.functions.text import strip
from quirelake.session import exists, kept


@F.pandas_udf(T.StringType())
def indented(record: pd.Series) -> pd.Series:
    """JSON written anew with one space a level, characters beyond ASCII as they are."""
    return record.map(lambda r: None if r is None else json.dumps(json.loads(r), ensure_ascii=False, indent=1))


def write_records(records: DataFrame, folder: str) -> None:
    """The JSON text of every document (columns name, record) in a bounded number of files below ``folder``.

    Files hold ranges of names in order, so that their statistics are the index: who looks for a
    name opens one file. Names stay text as they are; one that comes twice keeps all its records.
    """
    told = records.select(F.col("name").cast("string").alias("name"), indented("record").alias("record"))
    told.repartitionByRange("name").sortWithinPartitions("name", "record").write.mode("overwrite").parquet(folder)


def read_records(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """name, record of every document (or of those named) by name; no row where nothing was written."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "name string, record string")
    found = spark.read.schema("name string, record string").parquet(folder)
    return (found if names is None else found.where(F.col("name").isin(names))).orderBy("name", "record")


def write_combined(records: DataFrame, folder: str) -> None:
    """All records as one JSON list in input order (columns doc_idx, record).

    The list is cut into part files: read in the order of their names, line by line, they are one
    JSON text. Records of one doc_idx follow each other in any order, those without one come last;
    null records are left out. Only the first place reaches the driver.
    """
    spark = records.sparkSession
    place = F.struct(F.col("doc_idx").isNull().alias("last"), "doc_idx", "row")
    # Numbered and written, so that exactly one row is the first.
    told = kept(records.where("record is not null").select("doc_idx", indented("record").alias("value"), F.monotonically_increasing_id().alias("row")))
    first = told.agg(F.min(place).alias("p")).first()["p"]
    opened = told.select(F.lit(0).alias("kind"), place.alias("place"), F.concat(F.when(F.col("row") == (first["row"] if first else -1), "[").otherwise(","), "value").alias("value"))
    closing = spark.range(1).select(F.lit(1).alias("kind"), F.lit(None).cast(opened.schema["place"].dataType).alias("place"), F.lit("]" if first else "[]").alias("value"))
    opened.unionByName(closing).orderBy("kind", "place").select("value").write.mode("overwrite").text(folder)


def read_combined(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """position (from 0) and the fields of ``schema`` of every record of such a list, in order; none where nothing was written.

    Every record but the first starts a line with a comma, so the parts are read as records apart,
    however large the list.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], f"position long, {schema}")
    text = spark.read.option("lineSep", "\n").text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    numbered = line_numbers(text)
    begins = numbered.withColumn("record_no", F.sum(F.when(F.col("value").rlike(r"^[\[,]"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    own = begins.where(~F.col("value").isin("]", "[]")).groupBy("file", "record_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("json"), F.min("line").alias("line"))
    parsed = own.withColumn("r", F.from_json(F.substring("json", 2, 1 << 30), schema))
    sizes = parsed.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # One row for each part file.
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return parsed.withColumn("place", place).join(before, "file").select((F.col("before") + F.col("place")).cast("long").alias("position"), "r.*")


def line_numbers(lines: DataFrame) -> DataFrame:
    """Adds line (from 1 in its file) to rows of (value, file, block, at): the order of a file's blocks, then of lines in a block."""
    own = Window.partitionBy("file", "block").orderBy("at")
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.withColumn("nth", F.row_number().over(own)).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("nth")).cast("long").alias("line"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files of any size, blank lines included."""
    return line_numbers(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))


def response_text(outputs: Column) -> Column:
    """Outputs of a page that are not null, stripped, joined by a blank line."""
    return F.array_join(F.transform(F.filter(outputs, lambda o: o.isNotNull()), strip), "\n\n")


def zipped(left: Column, right: Column, what: str = "outputs") -> Column:
    """Pairs (one, two) by position; arrays of different lengths are an error."""
    paired = F.arrays_zip(left.alias("one"), right.alias("two"))
    return F.when(F.size(left) == F.size(right), paired).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.size(left).cast("string"), F.lit(" asked for, got "), F.size(right).cast("string"))))


def run_statistics(documents: DataFrame, seconds: float) -> DataFrame:
    """submitted_docs, submitted_pages, skipped_docs, seconds_per_doc of (pages, skipped); the mean is 0 seconds' share without documents."""
    asked = F.count_if(~F.col("skipped"))
    return documents.agg(
        asked.alias("submitted_docs"), F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("pages"))), F.lit(0)).cast("long").alias("submitted_pages"), F.count_if("skipped").alias("skipped_docs"),
        (F.lit(seconds) / F.greatest(F.lit(1), asked)).alias("seconds_per_doc"),
    )
