"""Job state as a keyed processor: steps are judged as they arrive, and ended jobs expire by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirelake.operators.scheduling import STEPS

ENDED = ("succeeded", "failed")


class JobState(StatefulProcessor):
    """One job: its status, the statuses it took, and how often each was refused.

    A step that its status doesn't allow is refused and changes nothing. A job that has ended goes
    ``keep`` microseconds after its last step: at once if a later row shows that the time is over,
    else by a timer when the watermark gets there. The next row then starts a new job.
    """

    def __init__(self, keep: int):
        self.keep_for = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, at long")
        self.path = handle.getListState("path", "status string")
        self.refused = handle.getMapState("refused", "status string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs() * 1000
        came = pd.concat(list(rows)).sort_values(["at", "event_id"])
        now, at = self.status.get() if self.status.exists() else (None, None)
        out = []
        for event, status, moment in zip(came["event_id"].tolist(), came["status"].tolist(), came["at"].tolist(), strict=True):
            if moment < border:
                out.append(("late", event, status, moment, now, False, None, None))
                continue
            if now in ENDED and moment > at + self.keep_for:
                out.append(self.gone(now, at))
                now = at = None
            legal = status in STEPS[now]
            out.append(("step", event, status, moment, now, legal, None, None))
            if legal:
                now, at = status, moment
                self.path.appendValue((status,))
            else:
                n = self.refused.getValue((status,))[0] if self.refused.containsKey((status,)) else 0
                self.refused.updateValue((status,), (n + 1,))
        if now is not None:
            self.status.update((now, at))
        self.wait(now, at)
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.status.exists():
            now, at = self.status.get()
            if now in ENDED and self.expires(at) <= timerValues.getCurrentWatermarkInMs():
                yield self.frame(key, [self.gone(now, at)])

    def gone(self, status: str, at: int) -> tuple:
        """The row of a job that expires; its state is cleared."""
        path = ">".join(s[0] for s in self.path.get())
        refused = sum(n[0] for n in self.refused.values())
        for state in (self.status, self.path, self.refused):
            state.clear()
        return "expired", None, status, at, None, None, path, refused

    def expires(self, at: int) -> int:
        return (at + self.keep_for) // 1000 + 1

    def wait(self, now: str | None, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now in ENDED:
            self.handle.registerTimer(self.expires(at))

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["kind", "event_id", "status", "at", "before", "legal", "path", "refused"], dtype=object)
        made.insert(0, "job_id", key[0])
        return made.astype({"event_id": "Int64", "at": "Int64", "refused": "Int64", "legal": "boolean"})


def job_states(events: DataFrame, keep_seconds: int, delay: str) -> DataFrame:
    """job_id, kind, event_id, status, at, before, legal, path, refused from a stream of (job_id, event_id, status, ts).

    kind is ``step`` for every event in time, with the status before it and whether it was allowed;
    ``late`` for events behind the watermark, which change nothing; and ``expired`` for a job that
    ended ``keep_seconds`` ago, with the statuses it took and the number of steps refused. Events
    without a time are left out.
    """
    timed = events.where("ts is not null").withWatermark("ts", delay)
    # Computed from the time, so that Spark itself drops no late row before the state sees it.
    rows = timed.select("job_id", "event_id", "status", (F.unix_micros("ts") + 0).alias("at"))
    made = rows.groupBy("job_id").transformWithStateInPandas(JobState(keep_seconds * 1_000_000), "job_id long, kind string, event_id long, status string, at long, before string, legal boolean, path string, refused long", "append", "eventTime")
    return made.withColumn("at", F.timestamp_micros("at"))
