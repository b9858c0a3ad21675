"""Streams over several runs, each from the checkpoint of the one before, with late and repeated rows."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirelake.operators.scheduling import STEPS
from quirelake.streaming import batches, commits, completion, jobs, joins, sessions

START = dt.datetime(2024, 5, 1)


def minute(m):
    return START + dt.timedelta(minutes=m)


class Feed:
    """A folder of files that grows; every call of ``rows`` adds a file and takes the stream to its present end."""

    def __init__(self, spark, folder, kind):
        self.spark, self.folder, self.kind = spark, str(folder), kind
        spark.createDataFrame([], kind).write.parquet(f"{folder}/in")

    def stream(self):
        return self.spark.readStream.schema(self.kind).parquet(f"{self.folder}/in")

    def add(self, rows):
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, plan, rows):
        self.add(rows)
        return batches.drained(plan(self.stream()), self.folder).collect()


def test_interval_join_with_late_rows_on_either_side(spark, tmp_path):
    feed = Feed(spark, tmp_path, "side string, user long, id long, at timestamp")
    plan = lambda s: joins.interval_join(s.where("side = 'l'").select("user", "at", F.col("id").alias("l")), s.where("side = 'r'").select("user", "at", F.col("id").alias("r")), "user", "60 minutes", "10 minutes", "left").select("l", "r")
    feed.run(plan, [("r", 1, 100, minute(0)), ("l", 1, 1, minute(30)), ("l", 2, 2, minute(31)), ("r", 1, 101, minute(61))])
    # The right row of minute 0 still stands in state for a left row of minute 55; both watermarks are past minute 20.
    feed.run(plan, [("l", 1, 3, minute(55)), ("l", 1, 4, minute(90)), ("r", 3, 102, minute(300)), ("l", 3, 5, minute(300))])
    # Behind the watermark (minute 290): neither finds a partner any more.
    got = feed.run(plan, [("l", 1, 6, minute(62)), ("r", 2, 103, minute(20)), ("r", 3, 104, minute(295)), ("l", 3, 7, minute(400)), ("r", 3, 105, minute(400))])
    pairs = Counter((r.l, r.r) for r in got)
    assert pairs[1, 100] == 1 and pairs[3, 100] == 1 and pairs[4, 101] == 1 and pairs[5, 102] == 1 and pairs[5, 104] == 1 and pairs[7, 105] == 1
    assert pairs[2, None] == 1  # out when the watermark had passed it, and never with the late right row
    assert not any(l == 6 and r for l, r in pairs) and not any(r == 103 for _, r in pairs)
    assert max(pairs.values()) == 1


def test_sessions_lose_no_row(spark, tmp_path):
    rnd = random.Random(5)
    feed, total, got = Feed(spark, tmp_path, "user long, ts timestamp"), 0, []
    plan = lambda s: sessions.sessions(s, "user", "ts", 600, "30 minutes")
    ahead = -30.0
    kept, late = defaultdict(list), Counter()
    for step in range(4):
        base = step * 120
        rows = [(rnd.randrange(3), base + rnd.uniform(-200, 60)) for _ in range(60)] + [(None, base + 1.0)]
        for user, m in rows:
            if minute(m) < minute(ahead - 30) and step:
                late[user] += 1
            else:
                kept[user].append(minute(m))
        ahead = max(ahead, max(m for _, m in rows))
        total += len(rows)
        got = feed.run(plan, [(u, minute(m)) for u, m in rows])
    assert Counter(r.user for r in got if r.kind == "late") == late and sum(late.values()) > 5
    got = feed.run(plan, [(9, minute(5000))])  # lets every session end
    want = Counter()
    for user, times in kept.items():
        own = sessions.merged([(t, t, 1) for t in times], dt.timedelta(minutes=10))
        want.update((user, *s) for s in own)
    assert Counter((r.user, r.first, r.last, r.n) for r in got if r.kind == "session") == want
    assert sum(r.n for r in got) == total


def test_sessions_merge_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user long, ts timestamp")
    plan = lambda s: sessions.sessions(s, "user", "ts", 600, "60 minutes")
    feed.run(plan, [(1, minute(0)), (1, minute(18)), (2, None)])
    feed.run(plan, [(1, minute(9))])  # closes the gap between two open sessions
    got = feed.run(plan, [(2, minute(500))])
    assert [(r.user, r.first, r.last, r.n) for r in got] == [(1, minute(0), minute(18), 3)]


def by_hand(events, keep):
    """(rows, jobs still held) of one job's events in order."""
    now = at = None
    path, refused, out = [], 0, []
    for event, status, m in events:
        if now in jobs.ENDED and m > at + keep:
            out.append(("expired", None, now, minute(at), None, None, ">".join(path), refused))
            now, path, refused = None, [], 0
        legal = status in STEPS[now]
        out.append(("step", event, status, minute(m), now, legal, None, None))
        if legal:
            now, at, path = status, m, [*path, status]
        else:
            refused += 1
    return out, (now, at, path, refused)


def test_job_states_over_restarts(spark, tmp_path):
    rnd = random.Random(8)
    feed = Feed(spark, tmp_path, "job_id long, event_id long, status string, ts timestamp")
    plan = lambda s: jobs.job_states(s, 60 * 60, "5 minutes")
    told, number = defaultdict(list), 0
    for step in range(3):
        rows = []
        for m in sorted(rnd.uniform(step * 200, step * 200 + 199) for _ in range(60)):
            number += 1
            rows.append((rnd.randrange(4), number, rnd.choice([s for s in STEPS if s]), m))
        for job, event, status, m in rows:
            told[job].append((event, status, m))
        rnd.shuffle(rows)
        got = feed.run(plan, [(j, e, s, minute(m)) for j, e, s, m in rows])
    late = feed.run(plan, [(0, 999, "queued", minute(3)), (77, 1000, "queued", minute(2000)), (0, 1001, None, None)])
    want = Counter()
    for job, events in told.items():
        rows, (now, at, path, refused) = by_hand(events, 60)
        want.update((job, *r) for r in rows)
        if now in jobs.ENDED:
            want[job, "expired", None, now, minute(at), None, None, ">".join(path), refused] += 1
    want[0, "late", 999, "queued", minute(3), next(r for r in late if r.kind == "late").before, False, None, None] += 1
    want[77, "step", 1000, "queued", minute(2000), None, True, None, None] += 1
    seen = Counter((r.job_id, r.kind, r.event_id, r.status, r["at"], r.before, r.legal, r.path, r.refused) for r in late)
    assert seen == want and len(got) < len(late)


def test_a_document_comes_out_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, "doc_id long, page long, page_count long, characters long")
    plan = completion.completed
    first = feed.run(plan, [(1, 0, 1, 5), (1, 0, 1, 5), (2, 0, 3, 7), (2, 2, 3, 9), (3, 1, 2, 1)])
    assert [tuple(r) for r in first] == [(1, 1, 5)]
    second = feed.run(plan, [(1, 0, 1, 5), (2, 0, 3, 7), (2, 1, 3, 8), (3, 1, 2, 1)])
    assert sorted(map(tuple, second)) == [(1, 1, 5), (2, 3, 24)]
    third = feed.run(plan, [(2, 0, 3, 7), (2, 1, 3, 8), (2, 2, 3, 9), (1, 0, 1, 5), (3, 0, 2, 2)])
    assert sorted(map(tuple, third)) == [(1, 1, 5), (2, 3, 24), (3, 2, 3)]


def test_replayed_and_killed_batches_leave_one_copy(spark, tmp_path):
    folder, state = str(tmp_path / "sink"), str(tmp_path / "state")
    feed = Feed(spark, tmp_path / "feed", "id long")
    feed.add([(1,), (2,)])
    commits.run_committed(feed.stream(), folder, state)
    feed.add([(3,)])
    real = commits.CommitLog.add

    def dies(self, batch, data, rows):
        raise RuntimeError("killed before the entry")

    commits.CommitLog.add = dies
    try:
        with pytest.raises(Exception, match="killed before the entry"):
            commits.run_committed(feed.stream(), folder, state)
    finally:
        commits.CommitLog.add = real
    kind = feed.stream().schema
    ids = lambda **k: sorted(r.id for r in commits.read_committed(spark, folder, kind, **k).collect())
    assert ids() == [1, 2]
    commits.run_committed(feed.stream(), folder, state)  # goes on where it was killed
    assert ids() == [1, 2, 3] and ids(up_to=0) == [1, 2]
    write = commits.committer(folder)
    write(spark.createDataFrame([(3,)], kind), 1)  # the batch once more
    assert ids() == [1, 2, 3]
    assert len(commits.clean(spark, folder)) == 1 and ids() == [1, 2, 3] and commits.clean(spark, folder) == []
    assert commits.read_committed(spark, str(tmp_path / "nothing"), kind).collect() == []


def test_the_later_of_two_attempts_loses(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    assert log.add(4, "batch-a", 1) and not log.add(4, "batch-b", 2)
    assert [e["data"] for e in log.entries()] == ["batch-a"]


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(batches._STORE, None)
    with batches.state_on_disk(spark):
        assert "RocksDB" in spark.conf.get(batches._STORE)
    assert spark.conf.get(batches._STORE, None) == before
