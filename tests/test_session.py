"""What is kept between steps."""

from pyspark.sql import functions as F

from quirelake.operators import blocks
from quirelake.session import exists, kept, kept_in_buckets, shared_dir


def test_frames_in_equal_buckets_join_without_a_shuffle(spark):
    place = ["doc_id", "block_idx"]
    own = spark.range(400).select((F.col("id") % 37).alias("doc_id"), F.floor(F.col("id") / 37).alias("block_idx"), F.col("id").cast("string").alias("raw"))
    asked, first, again = (kept_in_buckets(df, place, 4) for df in (own.drop("raw"), own.where("block_idx % 2 = 0"), own.where("block_idx % 3 = 0").withColumnRenamed("raw", "later")))
    joined = blocks.merged(asked, first.hint("merge"), place).join(again.hint("merge"), place, "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    plain = own.withColumns({"later": F.when(F.col("block_idx") % 3 == 0, F.col("raw")), "raw": F.when(F.col("block_idx") % 2 == 0, F.col("raw")).otherwise("")})
    columns = [*place, "raw", "later"]
    assert sorted(map(repr, joined.select(columns).collect())) == sorted(map(repr, plain.select(columns).collect()))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quirelake_")]


def test_kept_frames_are_read_back(spark):
    assert kept(spark.range(5)).count() == 5
    assert exists(spark, shared_dir(spark)) and not exists(spark, shared_dir(spark) + "/nothing")
