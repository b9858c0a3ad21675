"""Session builder with the settings every plan here assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the plans rely on for right results or for adaptive re-planning.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "quirelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS and then ``conf`` (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only on one machine (tests) a temporary folder stands in where that is unset; on a cluster it
    would be another folder on every machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quirelake-"))
    return f"file://{_LOCAL[0]}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the shared folder and read back, so that no lost executor takes it along."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_in_buckets(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The same, dealt into ``buckets`` by ``keys`` and sorted: frames kept with equal keys and buckets join by them without a shuffle.

    One file per bucket. The table's name leaves the catalog at once; only its files stay.
    """
    spark, name = df.sparkSession, f"quirelake_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved here, while the name is known
    spark.sql(f"drop table {name}")
    return found
