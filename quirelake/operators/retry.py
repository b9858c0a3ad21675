"""Bounded retries of a model over the rows whose output repeats itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import is_repetitive, retry_temperature
from quirelake.session import kept

#: A model turns a frame with the columns key, question and attempt into one with raw added.
Model = Callable[[DataFrame, Column], DataFrame]


def stand_in(rows: DataFrame, temperature: Column) -> DataFrame:
    """A deterministic model: repeats itself for every third key until the attempt reaches key modulo 4."""
    stuck = (F.col("key") % 3 == 0) & (F.col("attempt") < F.col("key") % 4)
    said = F.concat(F.lit("text "), F.col("key").cast("string"), F.lit(" at "), F.format_number(temperature, 1))
    return rows.withColumn("raw", F.when(stuck, F.repeat(F.concat(F.lit("again "), F.col("key").cast("string"), F.lit(" ")), 20)).otherwise(said))


def with_retries(rows: DataFrame, model: Model, most: int = 3) -> DataFrame:
    """key, question, attempt, raw, repetitive after at most ``most`` further rounds with rising temperature.

    Each round runs the model over the flagged rows alone; the last answer stands. A round's
    answers are kept, so that no later round asks the model for them again.
    """
    now = kept(model(rows.withColumn("attempt", F.lit(0)), F.lit(0.0)).withColumn("repetitive", is_repetitive(F.col("raw"))))
    settled = now.where(~F.col("repetitive"))
    flagged = now.where("repetitive")
    for k in range(most):
        if flagged.isEmpty():
            break
        asked = flagged.drop("raw", "repetitive").withColumn("attempt", F.lit(k + 1))
        again = kept(model(asked, retry_temperature(F.lit(k))).withColumn("repetitive", is_repetitive(F.col("raw"))))
        settled = settled.unionByName(again.where(~F.col("repetitive")))
        flagged = again.where("repetitive")
    return settled.unionByName(flagged)
