"""Job state from events, retention, error envelopes, archives and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.session import kept

ACTIVE = ("queued", "processing", "extracting")
# Status and code of each error; anything else is (400, INVALID_REQUEST).
ERRORS = [
    ("UnsupportedMediaError", 415, "UNSUPPORTED_MEDIA_TYPE"),
    ("InvalidMediaError", 400, "INVALID_MEDIA"),
    ("UploadTooLargeError", 413, "UPLOAD_TOO_LARGE"),
    ("PageLimitExceededError", 422, "PAGE_LIMIT_EXCEEDED"),
    ("ServiceBusyError", 429, "SERVICE_BUSY"),
    ("ArtifactNotFoundError", 404, "ARTIFACT_NOT_FOUND"),
    ("BackendUnavailableError", 503, "BACKEND_UNAVAILABLE"),
]


def latest_status(events: DataFrame, job: str, status: str, order: list[str]) -> DataFrame:
    """job, status, last_event: the newest event of each job."""
    last = F.max_by(F.struct(F.col(status).alias("status"), F.col(order[0]).alias("at")), F.struct(*order))
    return events.groupBy(job).agg(last.alias("l")).select(job, F.col("l.status").alias("status"), F.col("l.at").alias("last_event"))


def expired(workspaces: DataFrame, protected: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Workspaces (id, mtime in seconds) strictly older than the limit and not protected by id."""
    return workspaces.where(F.col("mtime") < now - ttl_seconds).join(protected, "id", "left_anti")


def envelopes(errors: DataFrame) -> DataFrame:
    """Adds http_status, internal_code and retry_after (seconds, for 429) by error name."""
    table = errors.sparkSession.createDataFrame(ERRORS, "error string, http_status int, internal_code string")
    joined = errors.join(F.broadcast(table), "error", "left")
    status = F.coalesce("http_status", F.lit(400))
    return joined.withColumns({"http_status": status, "internal_code": F.coalesce("internal_code", F.lit("INVALID_REQUEST")), "retry_after": F.when(status == 429, F.lit(1))})


def safe_member(path: Column) -> Column:
    """Whether an archive member stays inside: relative, no parent steps, no drive."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~plain.startswith("/") & ~F.array_contains(F.split(plain, "/"), "..") & ~plain.rlike("^[A-Za-z]:")


def within_budget(members: DataFrame, archive: str, order: str, size: str, most_bytes: int) -> DataFrame:
    """Adds running (bytes so far in the archive) and fits.

    Members are range-sorted and summed up range by range; the totals of the ranges before are
    added. So an archive of very many members is no single task's work.
    """
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    # Written, so that every later step sees the same ranges.
    placed = kept(members.repartitionByRange(archive, order).withColumn("_range", F.spark_partition_id()))
    inside = placed.withColumn("_inside", F.sum(size).over(upto("_range", archive).orderBy(order)))
    totals = placed.groupBy(F.col(archive).alias("_archive"), F.col("_range").alias("_own")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(upto("_archive").orderBy("_own")) - F.col("_total"))  # a row for each range of an archive
    met = inside.join(before, (F.col("_range") == F.col("_own")) & F.col(archive).eqNullSafe(F.col("_archive")))
    running = F.col("_inside") + F.col("_before")
    return met.select(*[F.col(c) for c in members.columns], running.alias("running"), (running <= most_bytes).alias("fits"))


def manifest_measures(layers: DataFrame, base: DataFrame) -> DataFrame:
    """image, total_bytes, largest_own_layer, n_layers: layers (image, digest, size), base (digest)."""
    own = layers.join(base.select("digest").distinct().withColumn("is_base", F.lit(True)), "digest", "left")
    return own.groupBy("image").agg(F.sum("size").alias("total_bytes"), F.coalesce(F.max(F.when(F.col("is_base").isNull(), F.col("size"))), F.lit(0).cast("long")).alias("largest_own_layer"), F.count(F.lit(1)).alias("n_layers"))
