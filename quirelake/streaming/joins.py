"""Joins of two streams whose state has an end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, delay: str, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with those of ``right`` of one key at most ``within`` before them, as a stream.

    Both sides have columns key and at (a timestamp) and own names otherwise; the result has at and
    right_at. Each side waits in state only as long as the other's watermark (its newest time less
    ``delay``) allows a partner: a left row until the right watermark has passed it, a right row
    until the left watermark has passed it by ``within``. With ``how="left"`` a row without a
    partner comes out when it leaves the state. Rows behind the watermark of both streams (the
    lesser of the two) are late and find no partner.
    """
    one = left.withWatermark("at", delay)
    two = right.withColumnRenamed("at", "right_at").withColumnRenamed(key, "right_key").withWatermark("right_at", delay)
    near = (F.col(key) == F.col("right_key")) & (F.col("right_at") <= F.col("at")) & (F.col("right_at") >= F.col("at") - F.expr(f"interval {within}"))
    return one.join(two, near, "leftOuter" if how == "left" else "inner").drop("right_key")
