"""Blocks of documents: derivation, routing by label, merging of outputs, numbering, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions.text import PROMPTS, format_block, strip
from quirelake.operators.tables import otsl_to_html


def blocks_of(docs: DataFrame) -> DataFrame:
    """doc_id, block_idx, n_blocks, label, raw: one block per line.

    Labels by place: the first line is the Title, the last the Page-footer, every seventh a
    Section-header, all others Text.
    """
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    at, n = F.col("block_idx"), F.col("n_blocks")
    label = F.when(at == 0, "Title").when(at == n - 1, "Page-footer").when(at % 7 == 0, "Section-header").otherwise("Text")
    return lines.select("doc_id", F.size("lines").alias("n_blocks"), F.posexplode("lines").alias("block_idx", "raw")).withColumn("label", label)


def prompts(spark: SparkSession) -> DataFrame:
    """label, question: a dimension of fixed size."""
    return spark.createDataFrame(sorted(PROMPTS.items()), "label string, question string")


def routed(blocks: DataFrame) -> DataFrame:
    """Adds question (empty without one) and need_infer; the dimension's size is fixed, so it is broadcast."""
    joined = blocks.join(F.broadcast(prompts(blocks.sparkSession)), "label", "left")
    return joined.withColumn("need_infer", F.col("question").isNotNull()).withColumn("question", F.coalesce("question", F.lit("")))


def merged(blocks: DataFrame, outputs: DataFrame, on: list[str]) -> DataFrame:
    """Adds raw text from ``outputs`` (empty where none came)."""
    return blocks.join(outputs, on, "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def picture_number() -> Column:
    """0-based number of a picture among its document's, in reading order."""
    return F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx", "block_idx")) - 1


def picture_name(doc_name: Column, number: Column) -> Column:
    return F.concat(F.lit("../images/"), doc_name, F.lit("_sub"), number.cast("string"), F.lit(".jpg"))


def formatted(blocks: DataFrame) -> DataFrame:
    """Adds content by label, for blocks without tables and pictures."""
    return blocks.withColumn("content", format_block(F.col("label"), F.col("raw"), F.col("label").isin(*PROMPTS), F.lit(""), F.lit("")))


def formatted_whole(blocks: DataFrame, doc_name: Column, table_html: bool = True) -> DataFrame:
    """Adds content by label: tables as HTML (or as they came) and pictures by their number in the document.

    Only tables go through Python. blocks has doc_id, page_idx, block_idx, label and raw.
    """
    numbered = blocks.withColumn("picture", F.when(F.col("label") == "Picture", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("page_idx", "block_idx")) - 1))
    table = otsl_to_html(F.when(F.col("label") == "Table", strip(F.col("raw")))) if table_html else strip(F.col("raw"))
    content = format_block(F.col("label"), F.col("raw"), F.col("label").isin(*PROMPTS), table, picture_name(doc_name, F.col("picture")))
    return numbered.withColumn("content", content).drop("picture")


def markdown(blocks: DataFrame, order: list[str], keep_header_footer: bool = False) -> DataFrame:
    """doc_id, n_blocks, markdown from formatted blocks: ordered, trimmed, empties left out."""
    shown = blocks if keep_header_footer else blocks.where(~F.col("label").isin("Page-header", "Page-footer"))
    full = shown.withColumn("content", strip(F.coalesce("content", F.lit("")))).where("content <> ''")
    joined = full.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order, "content"))).alias("b"))
    text = strip(F.array_join(F.transform("b", lambda x: x["content"]), "\n\n"))
    text = F.replace(F.when(text == "", text).otherwise(F.concat(text, F.lit("\n"))), F.lit("�"), F.lit(""))
    return joined.select("doc_id", F.size("b").cast("long").alias("n_blocks"), text.alias("markdown"))


def pages_markdown(outputs: DataFrame) -> DataFrame:
    """doc_id, markdown of single-task outputs (doc_id, page_idx, raw): headings per page if there are several."""
    one = outputs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_idx", strip(F.coalesce("raw", F.lit(""))).alias("raw")))).alias("p"))
    several = strip(F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), x["raw"])), "\n\n"))
    text = F.when(F.size("p") == 1, F.col("p")[0]["raw"]).otherwise(several)
    return one.select("doc_id", F.when(text == "", text).otherwise(F.concat(text, F.lit("\n"))).alias("markdown"))


def collapsed_size(sizes: Column) -> Column:
    """JSON of an array of (width, height) pairs: the pair itself if there is one page."""
    return F.when(F.size(sizes) == 1, F.to_json(sizes[0])).otherwise(F.to_json(sizes))
