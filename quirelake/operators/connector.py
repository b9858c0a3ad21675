"""A model behind an HTTP endpoint for chat completions, called from executors.

Every partition keeps a bounded number of requests in flight; answers come back in the order of
the rows. Only failures that may pass are tried again, after a pause that doubles.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from quirelake.functions.assets import RETRYABLE

#: (url, body, timeout) to (status, answer).
Transport = Callable[[str, bytes, float], tuple[int, bytes]]
ANSWER = "raw string, attempts int, error string"
LONGEST_PAUSE = 30.0


def over_http(url: str, body: bytes, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as refused:
        return refused.code, refused.read()


@dataclass(frozen=True)
class Endpoint:
    """Where and how a model is asked. ``transport`` is replaced in tests."""

    base: str
    model: str
    max_tokens: int | None = None
    temperature: float | None = None
    top_p: float | None = None
    retries: int = 3
    pause: float = 0.5
    timeout: float = 600.0
    transport: Transport = over_http

    def body(self, question: str, image: str | None) -> bytes:
        content = ([{"type": "image_url", "image_url": {"url": image}}] if image else []) + [{"type": "text", "text": question}]
        asked = {"model": self.model, "temperature": self.temperature or 0, "messages": [{"role": "user", "content": content}]}
        extra = {"max_tokens": self.max_tokens, "top_p": self.top_p}
        return json.dumps(asked | {k: v for k, v in extra.items() if v is not None}).encode()

    def ask(self, question: str, image: str | None = None) -> tuple[str | None, int, str | None]:
        """(answer, attempts, error)."""
        error, attempt = "", 0
        for attempt in range(1, self.retries + 2):
            try:
                status, answer = self.transport(f"{self.base}/chat/completions", self.body(question, image), self.timeout)
                if status == 200:
                    return json.loads(answer)["choices"][0]["message"]["content"], attempt, None
                error = f"HTTP {status}"
                if status not in RETRYABLE:
                    break
            except OSError as broken:
                error = type(broken).__name__
            except (ValueError, KeyError, IndexError, TypeError):
                error = "an answer without a message"
                break
            if attempt <= self.retries:
                time.sleep(min(self.pause * 2 ** (attempt - 1), LONGEST_PAUSE))
        return None, attempt, error


def answered(rows: DataFrame, endpoint: Endpoint, concurrency: int = 8, fail_fast: bool = False) -> DataFrame:
    """Adds raw, attempts and error to rows with a question (and, if there is one, a column image with a data URI).

    A row that fails keeps its error and leaves the others alone; with ``fail_fast`` it ends the job.
    """
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                images = batch["image"] if "image" in columns else [None] * len(batch)
                waiting: deque[Future] = deque()
                got = []
                for question, image in zip(batch["question"], images, strict=True):
                    if len(waiting) >= 2 * concurrency:
                        got.append(waiting.popleft().result())
                    waiting.append(pool.submit(endpoint.ask, question, image))
                got += [w.result() for w in waiting]
                if fail_fast and (bad := next((g[2] for g in got if g[2]), None)):
                    raise RuntimeError(bad)
                yield batch.assign(raw=[g[0] for g in got], attempts=[g[1] for g in got], error=[g[2] for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, {ANSWER}")


class Held:
    """One backend per worker: kept while its settings stay the same, closed when others are asked for."""

    def __init__(self):
        self._key, self._backend = None, None

    def get(self, settings: dict, make: Callable[[dict], object]):
        key = json.dumps(settings, sort_keys=True, default=str)
        if key != self._key:
            if hasattr(self._backend, "close"):
                self._backend.close()
            self._key, self._backend = None, None
            self._backend = make(settings)
            self._key = key
        return self._backend


#: The worker's own.
BACKEND = Held()
