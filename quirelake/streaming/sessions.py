"""Sessions of a stream as merging keyed state; rows behind the watermark come out as late rows.

Spark's own session windows drop late rows in silence. Here every row comes out once: as part of a
session, or as a late row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN = "first long, last long, n long"


class Sessions(StatefulProcessor):
    """Open sessions of one key (times in microseconds), merged where a row or a session closes the gap between them.

    A session comes out when the watermark has passed its last row by the gap; a timer stands at the
    earliest of these times.
    """

    def __init__(self, gap: int, kind: str):
        self.gap, self.kind = gap, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(s) for s in self.open.get()]
        late = []
        for frame in rows:
            at = frame["at"].to_numpy()
            late += at[at < border].tolist()
            held += [(t, t, 1) for t in at[at >= border].tolist()]
        self.keep(merged(held, self.gap))
        if late:
            yield self.frame(key, "late", [(t, t, 1) for t in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs()
        held = [tuple(s) for s in self.open.get()]
        over = [s for s in held if self.expires(s) <= border]
        self.keep([s for s in held if self.expires(s) > border])
        if over:
            yield self.frame(key, "session", over)

    def expires(self, session: tuple[int, int, int]) -> int:
        """The watermark, in milliseconds, from which no row can join a session."""
        return (session[1] + self.gap) // 1000 + 1

    def keep(self, held: list[tuple[int, int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.open.put(held)
            self.handle.registerTimer(min(map(self.expires, held)))
        else:
            self.open.clear()

    def frame(self, key: tuple, kind: str, rows: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "kind": kind} | {c: [r[k] for r in rows] for k, c in enumerate(("first", "last", "n"))})


def merged(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions in order, those within ``gap`` of each other as one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(sessions):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def sessions(stream: DataFrame, key: str, time: str, gap_seconds: int, delay: str) -> DataFrame:
    """key, kind (session or late), first, last, n: closed sessions, and every row that came behind the watermark by itself.

    Rows at most ``gap_seconds`` apart are one session. A row is late if it is older than the
    watermark of its batch (the newest time of earlier batches less ``delay``). Rows without a time
    belong to no session and are left out; without a key they share the null key.
    """
    timed = stream.where(F.col(time).isNotNull()).withWatermark(time, delay)
    # Computed from the time, so that Spark itself drops no late row before the state sees it.
    rows = timed.select(F.col(key).alias("key"), (F.unix_micros(F.col(time)) + 0).alias("at"))
    kind = dict(rows.dtypes)["key"]
    made = rows.groupBy("key").transformWithStateInPandas(Sessions(gap_seconds * 1_000_000, kind), f"key {kind}, kind string, first long, last long, n long", "append", "eventTime")
    return made.select(F.col("key").alias(key), "kind", *[F.timestamp_micros(F.col(c)).alias(c) for c in ("first", "last")], "n")
