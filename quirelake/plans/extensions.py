"""Ordinary relational queries over the star schema: extensions, not capabilities of a document service."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.plans.parity import read
from quirelake.session import shared_dir
from quirelake.streaming import batches

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all
""")
def ext_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n"))


@query("""
select r_name, n_name, round(sum(o_totalprice), 2) as revenue, grouping(n_name)::int as is_total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)
""")
def ext_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.grouping("n_name").cast("int").alias("is_total"))


@query("""
select * from (select c_mktsegment, c_custkey, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey)::int as place from customer) where place <= 3
""")
def ext_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", place.alias("place")).where("place <= 3")


@query("""
with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from e)
select user_id, session::bigint as session, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts from s group by user_id, session
""")
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(own) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    cut = read(spark, sf_dir, "events").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
select p.event_id, p.user_id, v.event_id as last_view from (select * from events where event_type = 'purchase') p
asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by user_id, ts) v on p.user_id = v.user_id and p.ts >= v.ts
""")
def ext_asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by a union and a window: the last view at or before each purchase."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view")).withColumn("kind", F.when(F.col("event_type") == "view", 0).otherwise(1))
    own = Window.partitionBy("user_id").orderBy("ts", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_view", F.last(F.when(F.col("kind") == 0, F.col("event_id")), ignorenulls=True).over(own)).where("kind = 1").select("event_id", "user_id", "last_view")


@query("""
select c_custkey from customer where c_acctbal > 500 except all select o_custkey from orders where o_totalprice > 450000
""")
def ext_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 500").select("c_custkey")
    return rich.exceptAll(read(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")))


@query("""
select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by o_orderpriority
""")
def ext_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in ("F", "O", "P")))


@query("""
select c_mktsegment, count(distinct c_nationkey) as nations, round(quantile_cont(c_acctbal, 0.5), 6) as median, round(quantile_cont(c_acctbal, 0.9), 6) as p90 from customer group by c_mktsegment
""")
def ext_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "customer").groupBy("c_mktsegment")
    return own.agg(F.countDistinct("c_nationkey").alias("nations"), F.round(F.percentile("c_acctbal", 0.5), 6).alias("median"), F.round(F.percentile("c_acctbal", 0.9), 6).alias("p90"))


@query("""
select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::bigint as level, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)
""")
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


@query("""
select l_orderkey, l_linenumber, rank() over w as r, dense_rank() over (partition by l_orderkey order by l_returnflag) as d, ntile(3) over w as t, lag(l_partkey) over w as before, lead(l_partkey, 2) over w as after,
  first_value(l_partkey) over w as first, last_value(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and unbounded following) as last, nth_value(l_partkey, 2) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and unbounded following) as second,
  round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between 1 preceding and 1 following), 4) as near, count(*) over (partition by l_orderkey order by l_quantity range between 5 preceding and 5 following) as alike
from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)
""")
def ext_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey")
    own = by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.rank().over(own).alias("r"), F.dense_rank().over(by.orderBy("l_returnflag")).alias("d"), F.ntile(3).over(own).alias("t"), F.lag(c).over(own).alias("before"), F.lead(c, 2).over(own).alias("after"),
        F.first(c).over(own).alias("first"), F.last(c).over(whole).alias("last"), F.nth_value(c, 2).over(whole).alias("second"), F.round(F.sum("l_quantity").over(own.rowsBetween(-1, 1)), 4).alias("near"),
        F.count(F.lit(1)).over(by.orderBy("l_quantity").rangeBetween(-5, 5)).alias("alike"),
    )


@query("""
select p.event_id, count(v.event_id) as n_views from (select * from events where event_type = 'purchase') p left join (select * from events where event_type = 'view') v on v.user_id = p.user_id and v.ts between p.ts - interval 6 hour and p.ts group by p.event_id
""")
def ext_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user within six hours before a purchase; time slots make the range join an equi join."""
    e = read(spark, sf_dir, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    width = 6 * 3600
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("p_ts"), F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) - 1)).alias("slot"))
    v = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("v_ts"), F.floor(F.col("at") / width).alias("slot"))
    near = (F.col("v_ts") <= F.col("p_ts")) & (F.col("v_ts") >= F.col("p_ts") - F.expr("interval 6 hours"))
    return p.join(v, ["user_id", "slot"], "left").groupBy("event_id").agg(F.count_if(near).alias("n_views"))


@query("select o_custkey from orders where o_orderstatus = 'F' intersect all select o_custkey from orders where o_orderstatus = 'O'")
def ext_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda s: read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select("o_custkey")
    return by("F").intersectAll(by("O"))


@query("select format, s_suppkey, s_name, s_acctbal from supplier, (select unnest(['csv', 'json', 'orc', 'parquet']) as format)")
def ext_file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to and read from every file format."""
    own, found = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), None
    for kind in ("csv", "json", "orc", "parquet"):
        folder = f"{shared_dir(spark)}/format-{uuid.uuid4().hex}"
        own.write.format(kind).save(folder)
        back = spark.read.schema(own.schema).format(kind).load(folder).withColumn("format", F.lit(kind))
        found = back if found is None else found.unionByName(back)
    return found


@query("""
with w as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) as word from documents)
select doc_id, count(*) as n_words, max(length(word)) as longest, round(exp(avg(ln(length(word)))), 6) as typical from w group by doc_id
""")
def ext_python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function and aggregate functions of one's own, on Arrow batches; the words are made once."""
    word = re.compile("[A-Za-z]+")

    @F.udtf(returnType="word string, n int", useArrow=True)
    class Words:
        def eval(self, text: str) -> Iterator[tuple[str, int]]:
            for w in word.findall(text or ""):
                yield w, len(w)

    @F.pandas_udf("double")
    def geometric_mean(n: pd.Series) -> float:
        return math.exp(sum(map(math.log, n)) / len(n))

    @F.pandas_udf("long")
    def many(n: pd.Series) -> int:
        return len(n)

    @F.pandas_udf("long")
    def greatest(n: pd.Series) -> int:
        return int(n.max())

    spark.udtf.register("quirelake_words", Words)
    words = spark.sql("select doc_id, n from {docs}, lateral quirelake_words(text)", docs=read(spark, sf_dir, "documents"))
    return words.groupBy("doc_id").agg(many("n").alias("n_words"), greatest("n").alias("longest"), F.round(geometric_mean("n"), 6).alias("typical"))


@query("""
select o_orderpriority, strftime(o_orderdate, '%Y-%m') as month, count(*) as n, sum(datediff('day', o_orderdate::date, date '2000-01-01'))::bigint as days, max(strftime(o_orderdate, '%Y%m%d_%H%M%S')) as run_id from orders group by all
""")
def ext_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return own.groupBy("o_orderpriority", "month").agg(F.count(F.lit(1)).alias("n"), F.sum(F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))).cast("long").alias("days"), F.max(F.date_format("o_orderdate", "yyyyMMdd_HHmmss")).alias("run_id"))


@query("""
select event_type, count(json_extract(props, '$.k')) as n_k, sum(json_extract(props, '$.k')::bigint)::bigint as sum_k, count(*) filter (json_extract(props, '$.k')::bigint % 2 = 0) as n_even from events group by event_type
""")
def ext_json_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,long>"))
    k = F.try_element_at("m", F.lit("k"))
    return own.groupBy("event_type").agg(F.count(F.get_json_object("props", "$.k")).alias("n_k"), F.sum(k).alias("sum_k"), F.count_if(k % 2 == 0).alias("n_even"))


@query("""
with e as (select distinct event_id, ts, event_type from events),
w as (select date_trunc('hour', ts) as hour, event_type, count(*) as n from e group by all)
select hour, event_type, n from w where hour + interval 1 hour <= (select max(ts) - interval 10 minute from events)
""")
def ext_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream in which every event comes twice; an hour comes out when the watermark has passed it."""
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    stream = batches.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    once = twice.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
    return batches.drained(counted, folder)
