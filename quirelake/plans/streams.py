"""Queries that run the given tables as streams to their present end, with SQL for what must have come out by then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.plans.parity import _STATUS, read
from quirelake.session import shared_dir
from quirelake.streaming import batches, commits, jobs, joins, sessions

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select event_id, user_id, ts from events where event_type = 'view'),
m as (select least((select max(ts) from p), (select max(ts) from v)) - interval 10 minute as border),
j as (select p.event_id, v.event_id as view_id, p.ts from p join v on v.user_id = p.user_id and v.ts between p.ts - interval 6 hour and p.ts)
select event_id, view_id from j union all select event_id, null from p where event_id not in (select event_id from j) and ts < (select border from m)
""")
def ext_stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the user's views of the six hours before, both as streams; purchases without any come out when the watermark has passed them."""
    side = lambda kind, name: _events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", F.col("ts").alias("at"), F.col("event_id").alias(name))
    joined = joins.interval_join(side("purchase", "event_id"), side("view", "view_id"), "user_id", "6 hours", "10 minutes", "left")
    return batches.drained(joined.select("event_id", "view_id"), _folder(spark, "interval-join"))


@query("""
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh, event_id from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as nth from e),
g as (select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, nth)
select user_id, 'session' as kind, first_ts, last_ts, n from g where last_ts + interval 30 minute < (select max(ts) - interval 10 minute from events)
""")
def ext_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream, each out when the watermark has passed it; late rows would come out by themselves."""
    made = sessions.sessions(_events(spark, sf_dir), "user_id", "ts", 1800, "10 minutes")
    plain = made.select("user_id", "kind", *[F.col(c).cast("timestamp_ntz").alias(f"{c}_ts") for c in ("first", "last")], "n")
    return batches.drained(plain, _folder(spark, "sessions"))


@query(f"""
with recursive e as (select user_id as job_id, event_id, {_STATUS} as status, ts, row_number() over (partition by user_id order by ts, event_id) as nth from events),
legal(before_, status) as (values ('', 'queued'), ('queued', 'processing'), ('queued', 'failed'), ('processing', 'extracting'), ('processing', 'succeeded'), ('processing', 'failed'), ('extracting', 'succeeded'), ('extracting', 'failed')),
r as (
  select distinct job_id, 0::bigint as nth, null::bigint as event_id, null::varchar as status, null::timestamp as ts, '' as before_, false as legal, '' as now_, null::timestamp as since, '' as path, 0::bigint as refused, null::varchar as gone, null::timestamp as gone_at, null::varchar as gone_path, null::bigint as gone_refused from e
  union all
  select job_id, nth, event_id, status, ts, was, ok, case when ok then status else was end, case when ok then ts when over_ then null else since end,
    case when over_ then '' else path end || case when ok then case when over_ or path = '' then '' else '>' end || status else '' end, case when over_ then 0 else refused end + case when ok then 0 else 1 end,
    case when over_ then now_ end, case when over_ then since end, case when over_ then path end, case when over_ then refused end
  from (select *, exists (select 1 from legal l where l.before_ = was and l.status = s.status) as ok
    from (select *, case when over_ then '' else now_ end as was
      from (select e.job_id, e.nth, e.event_id, e.status, e.ts, r.now_, r.since, r.path, r.refused, coalesce(r.now_ in ('succeeded', 'failed') and e.ts > r.since + interval 6 hour, false) as over_
        from r join e on e.job_id = r.job_id and e.nth = r.nth + 1)) s)),
z as (select * from r qualify row_number() over (partition by job_id order by nth desc) = 1)
select job_id, 'step' as kind, event_id, status, ts as at_ts, nullif(before_, '') as before, legal, null as path, null::bigint as refused from r where nth > 0
union all select job_id, 'expired', null, gone, gone_at, null, null, gone_path, gone_refused from r where gone is not null
union all select job_id, 'expired', null, now_, since, null, null, path, refused from z where now_ in ('succeeded', 'failed') and since + interval 6 hour < (select max(ts) - interval 10 minute from events)
""")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events as a stream: every step judged, every ended job expired six hours later."""
    events = _events(spark, sf_dir).selectExpr("user_id as job_id", "event_id", f"{_STATUS} as status", "ts")
    made = jobs.job_states(events, 6 * 3600, "10 minutes").withColumn("at_ts", F.col("at").cast("timestamp_ntz")).drop("at")
    return batches.drained(made, _folder(spark, "job-states"))


@query("select event_id, user_id, value from events where event_type = 'purchase'")
def stream_committed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases through the committing sink: an attempt that dies before its entry, the stream, and the stream again without its checkpoint."""
    folder = _folder(spark, "committed")
    stream = _events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "value")
    read(spark, sf_dir, "events").select("event_id", "user_id", "value").write.parquet(f"{folder}/out/batch-{0:012d}-died")
    for attempt in (1, 2):
        commits.run_committed(stream, f"{folder}/out", f"{folder}/state-{attempt}")
    return commits.read_committed(spark, f"{folder}/out", stream.schema)
