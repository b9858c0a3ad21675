"""The pipeline end to end with models that are plain expressions."""

import json

from pyspark.sql import functions as F

from quirelake.engine import DocumentPipeline, records
from quirelake.functions.text import PROMPTS


def layout_model(rows, temperature):
    boxes = F.format_string(
        "[{'bbox': [0, 0, 500, 100], 'label': 'Title', 'content': ' t%d '}, {'bbox': [0, 100, 500, 500], 'label': 'Text', 'content': 'x'}, {'bbox': [0, 500, 1000, 900], 'label': 'Table'}, {'bbox': [500, 0, 1000, 100], 'label': 'Picture'}, {'bbox': [0,", F.col("page_idx")
    )
    return rows.withColumn("raw", F.when(F.col("question") == PROMPTS["LAYOUT"], boxes).otherwise(boxes))


def recognition_model(rows, temperature):
    q = F.col("question")
    stuck = (F.col("attempt") == 0) & q.startswith("Please output")
    return rows.withColumn("raw", F.when(q == PROMPTS["Table"], "<fcel>a<lcel><nl>").when(stuck, F.repeat(F.lit("again "), F.lit(60))).otherwise(F.concat(F.lit(" said at "), F.round(temperature, 1).cast("string"), F.lit(" "))))


def test_pages_become_markdown_and_records(spark):
    pages = spark.createDataFrame([(1, 0, 200, 100), (1, 1, 400, 300), (2, 0, 50, 50)], "doc_id long, page_idx int, width int, height int")
    pipe = DocumentPipeline(layout_model, recognition_model)
    page = "# said at 0.2\n\nsaid at 0.2\n\n<table><tr><td colspan=\"2\">a</td></tr></table>\n\n![image](../images/{}_sub{}.jpg)"
    got = {r.doc_id: r.markdown for r in pipe.parse(pages).collect()}
    assert got == {1: page.format(1, 0) + "\n\n" + page.format(1, 1) + "\n", 2: page.format(2, 0) + "\n"}
    made = {r.doc_id: json.loads(r.record) for r in records(pages, pipe.blocks(pages)).collect()}
    assert made[1]["image_size"] == [[200, 100], [400, 300]] and made[2]["image_size"] == [50, 50]
    assert [b["page_num"] for b in made[1]["layouts"]] == [1] * 4 + [2] * 4 and made[1]["layouts"][5]["bbox"] == [0, 30, 200, 150]
    whole = {(r.page_idx, r.block_idx): r.content for r in pipe.whole_pages(pages.where("doc_id = 1")).collect()}
    assert whole[1, 0] == "t1" and whole[0, 3] == ""


def test_single_tasks(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, page_idx int")
    pipe = DocumentPipeline(layout_model, recognition_model)
    assert {r.doc_id: r.markdown for r in pipe.recognize(pages, "text").collect()} == {1: "## Page 1\n\nsaid at 0.2\n\n## Page 2\n\nsaid at 0.2\n", 2: "said at 0.2\n"}
    assert {r.doc_id: r.markdown for r in pipe.recognize(pages.where("doc_id = 2"), "table").collect()} == {2: '<table><tr><td colspan="2">a</td></tr></table>\n'}
