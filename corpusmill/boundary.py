"""The boundary to models and services: requests and answers, routing, retries, rate limit, and the map over a table.

Nothing here calls a network by itself: a client is any object with ``generate``. Errors become rows, not exceptions.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Request:
    prompt: str
    system: str | None = None
    temperature: float = 0.0
    max_tokens: int = 1024
    seed: int | None = None
    structured: bool = True
    meta: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Answer:
    text: str
    model: str
    tokens: int | None = None
    latency_s: float | None = None
    attempted: tuple[str, ...] = ()


class Client(Protocol):
    def generate(self, request: Request, model: str) -> Answer: ...


class CallError(Exception):
    """A failed call. retry: the same model may be asked again; fatal: no other model would do better."""

    def __init__(self, message: str, status: int | None = None, retry: bool = False, fatal: bool = False):
        super().__init__(message)
        self.status, self.retry, self.fatal = status, retry, fatal


def of_status(status: int, message: str = "") -> CallError:
    """The class of a status: 401 and 403 are fatal, 400 too; 429, 5xx and time-outs may be retried; 402 and 404 are the
    model's own."""
    return CallError(message or f"status {status}", status, retry=status == 429 or status >= 500 or status == 408, fatal=status in (400, 401, 403))


def backoff(attempt: int, base: float = 1.0, most: float = 30.0, rng: random.Random | None = None) -> float:
    """Seconds before the next try: doubled each time, capped, a quarter more or less, a tenth of a second at least."""
    wait = min(base * 2**attempt, most)
    return max(0.1, wait * (1 + ((rng or random).random() - 0.5) / 2))


class RateLimit:
    """At most so many calls a minute of this process, evenly spaced."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 60 / per_minute if per_minute > 0 else 0.0, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


class Router:
    """Models in order until one answers. A fatal error ends it; a bad request is tried once more without structured
    output; calls that may be retried are, with growing waits."""

    def __init__(self, client: Client, models: list[str], retries: int = 2, limit: RateLimit | None = None, paid: Callable[[str], bool] | None = None, allow_paid: bool = True, sleep: Callable[[float], None] = time.sleep):
        self.client, self.retries, self.limit, self.sleep = client, retries, limit, sleep
        paid = paid or (lambda m: not m.endswith(":free"))
        self.models = [m for m in models if allow_paid or not paid(m)]

    def generate(self, request: Request) -> Answer:
        tried, last = [], CallError("no model to ask")
        for model in self.models:
            tried.append(model)
            asked, attempt = request, 0
            while True:
                if self.limit:
                    self.limit.wait()
                try:
                    a = self.client.generate(asked, model)
                    return Answer(a.text, a.model, a.tokens, a.latency_s, tuple(tried))
                except CallError as e:
                    last = e
                    if e.status == 400 and asked.structured:
                        asked = Request(**{**asdict(asked), "structured": False})
                        continue
                    if e.fatal:
                        raise
                    if not e.retry or attempt >= self.retries:
                        break
                    self.sleep(backoff(attempt))
                    attempt += 1
        raise last


class Stub:
    """A client that answers by a function; for dry runs and tests."""

    def __init__(self, answer: Callable[[Request], str]):
        self.answer = answer

    def generate(self, request: Request, model: str) -> Answer:
        return Answer(self.answer(request), model, max(1, len(request.prompt) // 4), 0.0)


OUT = "output_text string, model string, tokens long, latency_s double, error string"


def generated(rows: DataFrame, prompt: str, keep: list[str], make: Callable[[], Router]) -> DataFrame:
    """The kept columns and OUT of each row's prompt: the answer, or the error. make: builds the router, once a task, so
    that clients aren't pickled. A rate limit holds for each task: give it the limit's share, or use one partition."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        import pyarrow as pa

        router = make()
        for batch in batches:
            got = []
            for text in batch.column(len(keep)).to_pylist():
                try:
                    a = router.generate(Request(text or ""))
                    got.append((a.text, a.model, a.tokens, a.latency_s, None))
                except CallError as e:
                    got.append((None, None, None, None, str(e)))
            cols = list(zip(*got)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(cols, types))], names=[*keep, "output_text", "model", "tokens", "latency_s", "error"])

    return rows.select(*keep, prompt).mapInArrow(run, f"{schema}, {OUT}")


def cut_at_stops(text: str, stops: tuple[str, ...]) -> str:
    """The text before the first stop sequence."""
    at = min((i for s in stops if s and (i := text.find(s)) >= 0), default=len(text))
    return text[:at]
