"""Handlers over claims: user code in Arrow batches, middleware, settlement."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HandlerMissing
from .claims import apply_claims
from .transitions import settle

Handler = Callable[..., object]


@dataclass(frozen=True)
class Execution:
    """What a middleware sees of a job; attempts count from 1."""

    job_id: int
    type: str
    payload: dict
    queue: str
    attempts: int


@dataclass
class Handlers:
    """Handlers ``(job_id, payload, progress)`` by type, or factories of them,
    and middleware ``(execution, proceed)``, the first outermost."""

    by_type: dict[str, Handler] = field(default_factory=dict)
    factories: dict[str, Callable[[], Handler]] = field(default_factory=dict)
    middleware: list[Callable] = field(default_factory=list)

    def register(self, kind: str, handler: Handler) -> Handlers:
        if not kind.strip():
            raise ValueError("type must not be blank")
        self.by_type[kind] = handler
        return self

    def has(self, kind: str) -> bool:
        return kind in self.by_type or kind in self.factories

    def get(self, kind: str) -> Handler:
        if kind in self.by_type:
            return self.by_type[kind]
        if kind in self.factories:
            return self.factories[kind]()
        raise HandlerMissing(f"no handler for type {kind!r}")

    def types(self) -> list[str]:
        return sorted({*self.by_type, *self.factories})

    def unregister(self, kind: str) -> None:
        self.by_type.pop(kind, None)
        self.factories.pop(kind, None)

    def clear(self) -> None:
        self.by_type.clear()
        self.factories.clear()

    def run(self, execution: Execution, progress: Callable[[int | None, str | None], None]) -> object:
        handler = self.get(execution.type)
        inner = lambda: handler(execution.job_id, execution.payload, progress)
        return reduce(lambda proceed, layer: lambda: layer(execution, proceed), reversed(self.middleware), inner)()


_OUTCOME = "id long, ok boolean, bad_result boolean, result string, error string, trace string, progress int, message string, duration_ms double"


def execute(claimed: DataFrame, handlers: Handlers) -> DataFrame:
    """Outcomes of ``claimed(id, queue, type, payload, attempts)``: a row each.

    A missing handler or an exception is a failure; a result that is no JSON is
    one that no retry mends.  Of a handler's progress calls the last one counts,
    and settles with the outcome.  duration_ms is the time in the handler.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for job in batch.itertuples(index=False):
                said, began = [(None, None)], time.perf_counter()
                row = dict.fromkeys(x.split()[0] for x in _OUTCOME.split(", ")) | {"id": job.id, "ok": False, "bad_result": False}
                try:
                    payload = json.loads(job.payload or "{}")
                    value = handlers.run(Execution(job.id, job.type, payload, job.queue, job.attempts + 1), lambda percent=None, message=None, said=said: said.append((percent, message)))
                    row["ok"] = True
                    try:
                        row["result"] = None if value is None else json.dumps(value, allow_nan=False, sort_keys=True, separators=(",", ":"))
                    except (TypeError, ValueError) as e:
                        row |= {"ok": False, "bad_result": True, "error": f"result: {e}"}
                except Exception as e:  # noqa: BLE001  whatever a handler raises
                    row |= {"error": str(e) or type(e).__name__, "trace": type(e).__name__}
                row["progress"], row["message"] = said[-1]
                row["duration_ms"] = (time.perf_counter() - began) * 1000
                rows.append(row)
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _OUTCOME.split(", ")])
            yield frame.astype({"progress": "Int32"})

    return claimed.select("id", "queue", "type", "payload", "attempts").mapInPandas(run, _OUTCOME)


def requests_of(outcomes: DataFrame, jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """Settle requests: complete, retry while attempts are left, or fail."""
    met = outcomes.join(claims.select("id", "lease_token"), "id").join(jobs.select("id", "attempts", "max_attempts"), "id")
    more = ~F.col("bad_result") & (F.col("attempts") + 1 < F.col("max_attempts"))
    kind = F.when(F.col("ok"), "complete").when(more, "retry").otherwise("fail")
    return met.select("id", "lease_token", kind.alias("kind"), "result", "error", "trace", (F.col("attempts") + 1).alias("attempts"), "progress", "message", "duration_ms", "bad_result")


def process(jobs: DataFrame, claims: DataFrame, handlers: Handlers, now: Column, base: int = 2, cap: int = 300) -> tuple[DataFrame, DataFrame]:
    """Claims, runs and settles; the ledger after that, and the requests."""
    held = apply_claims(jobs, claims, now)
    running = held.join(claims.select("id"), "id", "left_semi")
    requests = requests_of(execute(running, handlers), running, claims)
    return settle(held, requests, now, base, cap).drop("affected"), requests
