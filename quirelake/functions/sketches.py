"""Distinct counts, quantiles and heavy hitters as binary states that merge over partitions and days.

A state is small whatever it has seen, so days are kept as states and any span of them is answered
by merging, without a look at the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-two logarithm of the registers of a distinct count; its standard error is 1.04 over their square root.
REGISTERS = 12
#: Size of a quantile state; ranks are off by less than RANK_ERROR with a probability of 0.99.
QUANTILES, RANK_ERROR = 400, 0.01
#: Items that a state of heavy hitters tracks; counts are off by less than 3.5 shares of 1/TRACKED of all rows.
TRACKED = 1_024


def distinct_error() -> float:
    """Three standard errors of a distinct count, as a share of it."""
    return 3 * 1.04 / (1 << REGISTERS) ** 0.5


def hitter_error(rows: Column) -> Column:
    return rows * (3.5 / TRACKED)


def states(rows: DataFrame, by: list[str], distinct: str, value: str, item: str) -> DataFrame:
    """One row per group: n, and the states distinct, quantiles (null if no value) and hitters."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, REGISTERS).alias("distinct"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILES).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {TRACKED})").alias("hitters"),
    )


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The states of larger groups from those of their parts."""
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.expr(f"approx_top_k_combine(hitters, {TRACKED})").alias("hitters"),
    )


def answers(held: DataFrame, shares: list[float], most: int) -> DataFrame:
    """``held`` with distinct, quantiles (one per share) and hitters read from its states.

    hitters (item, count) are the ``most`` most frequent of those that certainly exceed the error of
    their counts; every item with more than ``hitter_error`` rows does. Where all are rare there is none.
    """
    return held.withColumns({
        "distinct": F.hll_sketch_estimate("distinct"),
        "quantiles": F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(s)) for s in shares]),
        "hitters": F.expr(f"approx_top_k_estimate(hitters, {most})"),
    })


def hitters_hold(held: DataFrame, exact: DataFrame, by: str, most: int) -> DataFrame:
    """by, hitters_hold: whether the hitters of ``held`` (by, n, hitters) keep their bounds against exact figures (by, item, k).

    Every reported count is off by less than ``hitter_error``, and an item that is not reported has
    no more rows than that, or than the least of ``most`` reported ones allows.
    """
    told = held.select(by, F.inline("hitters")).select(F.col(by).alias("_by"), F.col("item").alias("_item"), F.col("count").alias("told"))
    least = held.select(by, hitter_error(F.col("n")).alias("error"), F.when(F.size("hitters") >= most, F.array_min(F.transform("hitters", lambda h: h["count"]))).otherwise(0).alias("least"))
    both = exact.join(F.broadcast(told), F.col(by).eqNullSafe(F.col("_by")) & F.col("item").eqNullSafe(F.col("_item")), "left").join(F.broadcast(least.withColumnRenamed(by, "_of")), F.col(by).eqNullSafe(F.col("_of")))
    right = F.when(F.col("told").isNull(), F.col("k") <= F.col("least") + F.col("error")).otherwise(F.abs(F.col("told") - F.col("k")) <= F.col("error"))
    return both.groupBy(by).agg(F.every(right).alias("hitters_hold"))
