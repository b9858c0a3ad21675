"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")  # a plain join with it can be split where a node has very many links
    return both.where(F.col("b") > F.col("a")).join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))  # a centre of many links is the least of them, so no node has many smaller ones
    others = down.join(least.hint("merge"), "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): one row per node that has a link. ``edges`` has longs a and b.

    Each round is a few joins of the links with per-node minima, all written to the shared folder;
    the number of rounds grows with the logarithm of the longest chain. Only two totals reach the
    driver per round.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        total = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if total == before or not total["n"]:
            break
        before = total
        now = materialize(_small_star(_large_star(now)), "stars")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
