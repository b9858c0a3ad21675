"""Streaming completion: a document is emitted once all of its pages have arrived, and only once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "doc_id long, pages long, characters long"
#: Milliseconds for which the pages of an unfinished document, and the mark of a finished one, are remembered.
FORGET_AFTER = 6 * 3600 * 1000


class Completion(StatefulProcessor):
    """State of one document: its pages while some are missing, then nothing but a mark.

    A timer forgets both ``forget_after`` milliseconds after the last page that came. While the
    mark stands, pages that come again change nothing. (State that ends by itself is tied to
    processing time, with which a run up to the present end of a stream never stops.)
    """

    def __init__(self, forget_after: int = FORGET_AFTER):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page long", "characters long")
        self.so_far = handle.getValueState("so_far", "pages long, characters long, expected long")
        self.done = handle.getValueState("done", "pages long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(came["arrived_ms"].max()) + self.forget_after)
        if self.done.exists():
            return
        held, characters, expected = self.so_far.get() if self.so_far.exists() else (0, 0, 0)
        expected = max(expected, int(came["page_count"].max()))
        once = came.drop_duplicates("page")
        fresh = [(int(p), int(n)) for p, n in zip(once["page"], once["characters"], strict=True) if not (held and self.pages.containsKey((int(p),)))]
        held, characters = held + len(fresh), characters + sum(n for _, n in fresh)
        if held >= expected:
            self.pages.clear()
            self.so_far.clear()
            self.done.update((held,))
            yield pd.DataFrame({"doc_id": [key[0]], "pages": [held], "characters": [characters]})
        else:
            for page, n in fresh:  # a document that is complete in one batch never gets here
                self.pages.updateValue((page,), (n,))
            self.so_far.update((held, characters, expected))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.pages, self.so_far, self.done):
            state.clear()
        yield from ()


def completed(pages: DataFrame, forget_after: int = FORGET_AFTER) -> DataFrame:
    """doc_id, pages, characters of every document, from a stream of (doc_id, page, page_count, characters).

    ``page`` counts from 0; a page that comes twice counts once, and a finished document comes out
    once, however often its pages return within ``forget_after`` milliseconds of the last of them.
    """
    now = F.current_timestamp()
    timed = pages.select("doc_id", "page", "page_count", "characters", now.alias("arrived")).withWatermark("arrived", "1 minute")
    own = timed.select("doc_id", "page", "page_count", "characters", F.unix_millis("arrived").alias("arrived_ms"))
    return own.groupBy("doc_id").transformWithStateInPandas(Completion(forget_after), OUTPUT, "append", "eventTime")
