"""Admission, fair rounds, micro-batches and job transitions as plans over events."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.session import kept

#: Arrivals of a range, which one task walks at a time.
RANGE = 250_000

#: What a job may become from each state; None is a new job.
STEPS = {None: ("queued",), "queued": ("processing", "failed"), "processing": ("extracting", "succeeded", "failed"), "extracting": ("succeeded", "failed"), "succeeded": (), "failed": ()}
RUNNING = ("processing", "extracting")


def transitions(events: DataFrame, job: str, status: str, order: list[str]) -> DataFrame:
    """Every event with the state before it (before), whether it may follow (legal) and its number in the job (nth, from 1)."""
    own = Window.partitionBy(job).orderBy(*order)
    before = F.lag(status).over(own)
    legal = F.lit(False)
    for state, then in STEPS.items():
        if then:
            legal = F.when(before.isNull() if state is None else before == state, F.col(status).isin(*then)).otherwise(legal)
    return events.withColumns({"before": before, "legal": legal, "nth": F.row_number().over(own)})


def deletable(status: Column) -> Column:
    """A job that runs can't be deleted."""
    return ~status.isin(*RUNNING)


def visible(jobs: DataFrame, session: str) -> DataFrame:
    """Jobs of one session, newest first."""
    return jobs.where(F.col("session_id") == session).orderBy(F.desc("created_at"), "id")


def admit(begins: np.ndarray, ends: np.ndarray, running: list[float], capacity: int) -> tuple[np.ndarray, list[float]]:
    """Which arrivals, in order, are accepted while ``running`` ends are open, and the ends open after them.

    Nulls are masked entries; a null begin lies before all others, a null end is over at once, NaN is
    the greatest number. While all places are taken the walk leaps to the first arrival after the next end.
    """
    taken, i, blank = np.zeros(len(begins), dtype=bool), 0, int(np.ma.count_masked(begins))
    known, gone = np.ma.getdata(begins)[blank:], np.ma.getmaskarray(ends)
    after = lambda e, b: e > b or (e != e and b == b)
    while i < len(begins):
        running = [] if i < blank else [e for e in running if after(e, known[i - blank])]
        if len(running) < capacity:
            taken[i] = True
            running += [] if gone[i] else [float(ends[i])]
            i += 1
        else:
            over = min((e for e in running if e == e), default=math.nan)
            i = max(i + 1, blank + int(np.searchsorted(known, over)))
    if len(known):  # what follows begins no earlier
        running = [e for e in running if after(e, known[-1])]
    return taken, sorted(running)


def admitted(arrivals: DataFrame, queue: str, capacity: int) -> DataFrame:
    """Adds accepted to arrivals (queue, id, begins, ends as numbers): refused at once where ``capacity`` accepted ones still run.

    Whether one is accepted depends on all before it, but only by the ends that are open then,
    ``capacity`` at most. So arrivals are sorted into ranges and every range is walked by itself; a
    range whose start turns out to differ from the one assumed (none open at first) is walked again
    until none does. Two walks from different starts soon agree where places fall free between the
    same two arrivals; at worst a queue takes as many rounds as it has ranges. A few numbers per range
    reach the driver.
    """
    rows = arrivals.select(queue, "id", "begins", "ends")
    order = [queue, "begins", "id", "ends"]
    sorted_ = rows.repartitionByRange(max(1, math.ceil(rows.count() / RANGE)), *order).sortWithinPartitions(*order)
    # The number holds the range in its upper bits and the place in the range in its lower ones.
    placed = sorted_.select("*", F.monotonically_increasing_id().alias("_at"), F.to_json(F.struct(queue)).alias("_name"))
    placed = kept(placed.withColumns({"_range": F.shiftright("_at", 33), "_begins": F.col("begins").cast("double"), "_ends": F.col("ends").cast("double")}))
    several = placed.groupBy("_name").agg(F.array_sort(F.collect_set("_range")).alias("ranges")).where(F.size("ranges") > 1).collect()  # no more queues than ranges
    before = {(r["_name"], k): j for r in several for j, k in zip(r["ranges"][:-1], r["ranges"][1:], strict=True)}
    starts: dict[tuple[str, int], list[float]] = {}

    def walked(table: pa.Table, starts: dict) -> tuple[pa.Table, np.ndarray, list[float]]:
        table = table.sort_by("_at")
        masked = lambda c: np.ma.array(table.column(c).fill_null(0).to_numpy(), mask=table.column(c).is_null().to_numpy())
        key = (table.column("_name")[0].as_py(), table.column("_range")[0].as_py())
        return table, *admit(masked("_begins"), masked("_ends"), starts.get(key, []), capacity)

    def states(given: dict) -> Callable[[pa.Table], pa.Table]:
        def state(table: pa.Table) -> pa.Table:
            table, _, running = walked(table, given)
            return table.slice(0, 1).select(["_name", "_range"]).append_column("running", pa.array([running], pa.list_(pa.float64())))

        return state

    todo = {(name, j) for (name, _), j in before.items()}
    while todo:
        part = placed.where(F.col("_range").isin(sorted({k for _, k in todo})) & F.col("_name").isin(sorted({n for n, _ in todo})))
        ends = {(r["_name"], r["_range"]): r["running"] for r in part.select("_name", "_range", "_at", "_begins", "_ends").groupBy("_name", "_range").applyInArrow(states({key: starts[key] for key in todo if key in starts}), "_name string, _range long, running array<double>").collect()}
        changed = {(name, k) for (name, k), j in before.items() if (name, j) in todo and repr(ends[name, j]) != repr(starts.get((name, k), []))}
        starts |= {(name, k): ends[name, before[name, k]] for name, k in changed}
        todo = changed & {(name, j) for (name, _), j in before.items()}

    def told(table: pa.Table) -> pa.Table:
        table, taken, _ = walked(table, starts)
        return table.select(names).append_column("accepted", pa.array(taken))

    names = rows.columns
    return placed.groupBy("_name", "_range").applyInArrow(told, T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())]))


def fair_rounds(pages: DataFrame) -> DataFrame:
    """Adds round and slot to pages (request_id, arrived, page_idx): one page per request and round, requests in order of arrival."""
    slot = F.row_number().over(Window.partitionBy("page_idx").orderBy("arrived", "request_id")) - 1
    return pages.withColumns({"round": F.col("page_idx"), "slot": slot})


def micro_batches(items: DataFrame, queue: str, most: int, wait: float) -> DataFrame:
    """Adds batch (from 0) to items (queue, id, at in seconds): a batch closes when it is full or ``wait`` seconds after its first item."""
    listed = items.groupBy(queue).agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("a"))
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.lit(0.0).alias("opened"), F.array().cast("array<int>").alias("out"))

    def take(s: Column, x: Column) -> Column:
        fresh = (s["batch"] < 0) | (s["n"] >= most) | (x["at"] >= s["opened"] + wait)
        batch = s["batch"] + F.when(fresh, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(fresh, 1).otherwise(s["n"] + 1).alias("n"), F.when(fresh, x["at"].cast("double")).otherwise(s["opened"]).alias("opened"), F.concat(s["out"], F.array(batch)).alias("out"))

    folded = listed.withColumn("out", F.aggregate("a", start, take)["out"])
    return folded.select(queue, F.explode(F.arrays_zip("a", "out")).alias("z")).select(queue, "z.a.id", "z.a.at", F.col("z.out").alias("batch"))


def bearer_accepted(header: Column, token: str) -> Column:
    """Whether an Authorization header carries the token; digests are compared, so time tells nothing about it."""
    scheme, credentials = F.substring_index(header, " ", 1), F.regexp_extract(header, r"(?s)^[^ ]* (.*)\z", 1)
    return F.coalesce((F.instr(header, " ") > 0) & (F.lower(scheme) == "bearer") & (credentials != "") & (F.sha2(credentials, 256) == F.sha2(F.lit(token), 256)), F.lit(False))


def is_bearer_token(value: Column) -> Column:
    """At least 32 characters that are safe in a header."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._~+/-]+=*\z") & (F.length(value) >= 32), F.lit(False))


def the_only(items: DataFrame, by: str, what: str) -> DataFrame:
    """by, what, found: the one item of each group; null, with the number found, where there is none or there are several."""
    own = items.groupBy(by).agg(F.count(what).alias("found"), F.min(what).alias(what))
    return own.select(by, F.when(F.col("found") == 1, F.col(what)).alias(what), "found")


def platform_digest(manifests: Column, system: str = "linux", architecture: str = "amd64") -> Column:
    """Digest of the one manifest (digest, platform.os, platform.architecture) for a platform; null unless there is exactly one."""
    fit = F.filter(manifests, lambda m: (m["platform"]["os"] == system) & (m["platform"]["architecture"] == architecture))
    return F.when(F.size(fit) == 1, F.get(fit, F.lit(0))["digest"])
