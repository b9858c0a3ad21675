"""A document pipeline from pages to blocks, Markdown and records; its models are slots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import PROMPTS
from quirelake.operators import blocks, layout
from quirelake.operators.retry import Model, with_retries

PLACE = ["doc_id", "page_idx", "block_idx"]
#: Tasks on whole pages, and the label whose prompt and format they use.
TASKS = {"text": "Text", "formula": "Formula", "table": "Table"}


class OcrPipeline(Protocol):
    """What a front end needs of a pipeline."""

    def parse(self, pages: DataFrame) -> DataFrame: ...

    def recognize(self, pages: DataFrame, task: str) -> DataFrame: ...


def unchanged(pages: DataFrame) -> DataFrame:
    return pages


@dataclass(frozen=True)
class DocumentPipeline:
    """Pages are rows of doc_id, page_idx, width, height and whatever else the models read.

    A model turns rows with key, question and attempt into rows with raw added. ``preprocess``
    works on pages before the layout model sees them (dewarping, say).
    """

    layout_model: Model
    recognition_model: Model
    preprocess: Callable[[DataFrame], DataFrame] = unchanged
    most_retries: int = 3

    def blocks(self, pages: DataFrame) -> DataFrame:
        """doc_id, page_idx, block_idx, label, bbox, raw and content of every block that the layout model finds."""
        found = self._asked(self.preprocess(pages), "LAYOUT")
        items = found.select("doc_id", "page_idx", F.posexplode(layout.page_items(F.col("raw"), F.col("width"), F.col("height"))).alias("block_idx", "item"))
        own = blocks.routed(items.select(*PLACE, F.col("item.label").alias("label"), F.col("item.bbox").alias("bbox")))
        tasks = own.where("need_infer").withColumn("key", F.xxhash64(*PLACE)).join(pages.drop("question", "key", "label", "bbox"), ["doc_id", "page_idx"])
        said = with_retries(tasks, self.recognition_model, self.most_retries).select(*PLACE, "raw")
        return self._formatted(blocks.merged(own, said, PLACE))

    def whole_pages(self, pages: DataFrame) -> DataFrame:
        """The same from one answer per page that has boxes, labels and contents at once; contents stay as they came."""
        found = self._asked(self.preprocess(pages), "END2END")
        items = found.select("doc_id", "page_idx", F.posexplode(layout.page_items(F.col("raw"), F.col("width"), F.col("height"))).alias("block_idx", "item"))
        return items.select(*PLACE, F.col("item.label").alias("label"), F.col("item.bbox").alias("bbox"), F.col("item.content").alias("raw"), F.col("item.content").alias("content"))

    def parse(self, pages: DataFrame) -> DataFrame:
        """doc_id, n_blocks, markdown."""
        return blocks.markdown(self.blocks(pages), PLACE[1:])

    def recognize(self, pages: DataFrame, task: str) -> DataFrame:
        """doc_id, markdown of a single task on whole pages."""
        said = self._asked(pages, TASKS[task]).withColumns({"block_idx": F.lit(0), "label": F.lit(TASKS[task])})
        shown = self._formatted(said).select("doc_id", "page_idx", F.col("content").alias("raw"))
        return blocks.pages_markdown(shown)

    def _asked(self, pages: DataFrame, prompt: str) -> DataFrame:
        asked = pages.withColumns({"key": F.xxhash64("doc_id", "page_idx"), "question": F.lit(PROMPTS[prompt])})
        return with_retries(asked, self.layout_model if prompt in ("LAYOUT", "END2END") else self.recognition_model, self.most_retries)

    @staticmethod
    def _formatted(found: DataFrame) -> DataFrame:
        return blocks.formatted_whole(found, F.col("doc_id").cast("string"))


def records(pages: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, record: JSON of a document's image sizes (the pair itself for one page) and its blocks in order."""
    sizes = pages.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_idx", F.array("width", "height").alias("size")))), lambda p: p["size"]).alias("sizes"))
    shown: Callable[[Column], Column] = lambda b: F.struct(F.array(*(b["bbox"][c] for c in ("x1", "y1", "x2", "y2"))).alias("bbox"), b["label"].alias("label"), b["content"].alias("content"), (b["page_idx"] + 1).alias("page_num"))
    listed = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "block_idx", "bbox", "label", "content"))), shown).alias("layouts"))
    one = F.to_json(F.struct(F.col("doc_id").cast("string").alias("image_name"), F.col("sizes")[0].alias("image_size"), F.coalesce("layouts", F.array().cast("array<struct<bbox:array<int>,label:string,content:string,page_num:int>>")).alias("layouts")))
    several = F.to_json(F.struct(F.col("doc_id").cast("string").alias("image_name"), F.col("sizes").alias("image_size"), F.coalesce("layouts", F.array().cast("array<struct<bbox:array<int>,label:string,content:string,page_num:int>>")).alias("layouts")))
    return sizes.join(listed, "doc_id", "left").select("doc_id", F.when(F.size("sizes") == 1, one).otherwise(several).alias("record"))
