"""Agreement of several predictions per block, and chat records for training.

The measure and the threshold of agreement are this library's choice: Jaccard similarity of word
sets, 0.6 on average between all pairs.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.operators.tables import from_html


def _similarity(x, y):
    """Of two arrays without repeats."""
    common = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - common
    return F.when(total > 0, common / total).otherwise(F.lit(1.0))


def agreed(blocks: DataFrame, least: float = 0.6) -> DataFrame:
    """page_id, block_idx, agreement, chosen for blocks of pages all of whose blocks agree.

    blocks: page_id, block_idx, p1, p2, p3. The prediction closest to the other two is chosen, the
    first of equals. Blocks are scored once and meet their page's least score in one shuffle.
    """
    words = {f"w{k}": F.array_distinct(F.split(f"p{k}", " ")) for k in (1, 2, 3)}
    pairs = {f"s{a}{b}": _similarity(F.col(f"w{a}"), F.col(f"w{b}")) for a, b in ((1, 2), (1, 3), (2, 3))}
    scored = blocks.withColumns(words).withColumns(pairs).drop(*words)
    s12, s13, s23 = F.col("s12"), F.col("s13"), F.col("s23")
    m1, m2, m3 = (s12 + s13) / 2, (s12 + s23) / 2, (s13 + s23) / 2
    best = F.greatest(m1, m2, m3)
    chosen = F.when(m1 == best, F.col("p1")).when(m2 == best, F.col("p2")).otherwise(F.col("p3"))
    closest = scored.select("page_id", "block_idx", ((s12 + s13 + s23) / 3).alias("agreement"), chosen.alias("chosen"))
    return closest.withColumn("worst", F.min("agreement").over(Window.partitionBy("page_id"))).where(F.col("worst") >= least).drop("worst")


def chat_records(turns: DataFrame) -> DataFrame:
    """conv_id, n_assistant, record (JSON of messages in order) from (conv_id, turn, role, text)."""
    messages = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    listed = turns.groupBy("conv_id").agg(messages.alias("m"))
    record = F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    return listed.select("conv_id", F.size(F.filter("m", lambda x: x["role"] == "assistant")).cast("long").alias("n_assistant"), record.alias("record"))


def _converted(value: str) -> tuple[str | None, str | None]:
    """(error, record) of a line: the record as it was, with the content of its assistant messages as OTSL."""
    try:
        record = json.loads(value)
    except ValueError:
        return "not a JSON text", None
    messages = record.get("messages") if isinstance(record, dict) else None
    if not isinstance(record, dict):
        return "not an object", None
    if not isinstance(messages, list):
        return "no list of messages", None
    if not all(isinstance(m, dict) for m in messages):
        return "a message is not an object", None
    said = [m for m in messages if m.get("role") == "assistant"]
    if not all(isinstance(m.get("content"), str) for m in said):
        return "an answer is not a text", None
    if not said:
        return "no answer", None
    for message in said:
        message["content"] = from_html(message["content"])
    return None, json.dumps(record, ensure_ascii=False)


@F.pandas_udf(T.StructType([T.StructField("error", T.StringType()), T.StructField("record", T.StringType())]))
def converted(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_converted(v) for v in values], columns=["error", "record"], dtype=object)


def checked_records(lines: DataFrame) -> DataFrame:
    """The columns of ``lines`` (with value, a JSON line) but value, and error, record; blank lines are left out.

    Every field of a record stays, whatever it is; only the contents of its assistant messages
    change, to OTSL. The error says what is wrong; such rows have no record.
    """
    full = lines.where(F.col("value").rlike(r"\S"))
    made = full.withColumn("made", converted("value"))
    return made.select(*[c for c in lines.columns if c != "value"], "made.error", "made.record")
