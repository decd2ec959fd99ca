"""A worker as a driver of micro-batches over a stored ledger.

A step is one transaction: it reads a version, promotes, dequeues, claims, runs
and settles a batch, and commits the rows that changed as the next version.  A
step that fails has changed nothing, so what it had dequeued is still pending.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import ReconcileOptions, WorkerOptions, backoff_seconds, is_infrastructure, moment
from . import events, notify, recovery, runner
from .claims import apply_claims, claim_by_id
from .reconcile import reconcile
from .transitions import settle


@dataclass(frozen=True)
class Taken:
    """Claims, and the notifications that the batch has touched: before it, and
    after those were dropped that nobody can claim."""

    claims: DataFrame
    before: DataFrame
    after: DataFrame


def claim_from_queue(jobs: DataFrame, notifications: DataFrame, most: int, now: Column, worker: str, version: int = 1) -> Taken:
    """Dequeues the oldest ``most`` of each queue and claims their jobs.

    An id whose job is not there, not due or another worker's is acknowledged:
    its notification goes, and the job is left as it is.  An id that was dequeued
    twice is claimed once.
    """
    before = notify.oldest_pending(notifications, most)
    moved = before.withColumn("list", F.lit("processing")).withColumn("score", now)
    asked = moved.select(F.col("job_id").alias("id"), F.lit(worker).alias("worker_id")).distinct()
    claims = claim_by_id(jobs, asked, now, version)
    mine = claims.select("queue", F.col("id").alias("job_id"))
    first = moved.groupBy("queue", "job_id", "list").agg(F.min("seq").alias("seq"))
    kept = moved.join(first, recovery.PLACE, "left_semi").join(mine, ["queue", "job_id"], "left_semi")
    return Taken(claims, before, kept.select(*notifications.columns))


@dataclass(frozen=True)
class Done:
    """A batch's changed jobs, its notifications before and after, its events."""

    jobs: DataFrame
    before: DataFrame
    after: DataFrame
    events: DataFrame
    requests: DataFrame


def run_batch(jobs: DataFrame, notifications: DataFrame, handlers: runner.Handlers, now: Column, most: int, worker: str, options: WorkerOptions | None = None, version: int = 1, latency_ms: float = 0.0, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Done:
    """Claims, runs and settles the oldest ``most`` of each queue.

    A job that is completed or has failed is acknowledged; one to be retried
    goes to the delayed set until it is due; a lost one's notification stays in
    processing.  ``keep`` stores a table that is read several times, above all
    the outcomes, so that no handler runs twice.
    """
    options = options or WorkerOptions()
    taken = claim_from_queue(jobs, notifications, most, now, worker, version)
    held = keep(apply_claims(jobs, taken.claims, now, touched=True))
    claims = held.select("id", "lease_token")
    outcomes = keep(runner.execute(held, handlers))
    requests = runner.requests_of(outcomes, held, claims)
    made = keep(settle(held, requests, now, options.retry_base_delay, options.retry_max_delay, touched=True))
    ends = made.select("queue", F.col("id").alias("job_id"), "status", "affected", "available_at")
    rows = taken.after.join(ends, ["queue", "job_id"])
    retry = (F.col("affected") == 1) & (F.col("status") == "pending")
    stay = rows.where((F.col("affected") == 0) | retry)
    new = {"list": F.when(retry, "delayed").otherwise(F.col("list")), "score": F.when(retry, F.col("available_at")).otherwise(F.col("score"))}
    after = stay.select(*(new.get(c, F.col(c)).alias(c) for c in notifications.columns))
    told = events.claimed(held, latency_ms).unionByName(events.settled(requests, held, made.select("id", "affected")))
    return Done(made.drop("affected"), taken.before, after, told, requests)


def _before(moved: DataFrame, which: str) -> DataFrame:
    """Rows that have moved, where they were."""
    return moved.select("queue", "job_id", F.lit(which).alias("list"), F.col("was").alias("seq"), "score")


@dataclass
class Worker:
    """The loop over a :class:`ledgerline.sources.ledger.LedgerStore`."""

    store: object
    queue: str
    handlers: runner.Handlers
    options: WorkerOptions = field(default_factory=WorkerOptions)
    listener: Callable[[dict], None] | None = None
    most: int = 100
    name: str = "worker"
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    memory: Callable[[], int] = lambda: 0
    processed: int = 0
    errors: int = 0
    cursor: int | None = None
    _started: float = 0.0
    _promoted: float = 0.0
    _recovered: float = 0.0

    def _now(self) -> Column:
        return moment(time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(self.clock())))

    def limits_reached(self) -> bool:
        """Whether the jobs, the seconds or the bytes of the options are used up; 0 is no limit."""
        o = self.options
        return bool(o.max_jobs and self.processed >= o.max_jobs or o.max_time and self.clock() - self._started >= o.max_time or o.memory_limit and self.memory() >= o.memory_limit)

    def start(self) -> None:
        """Recovers, reconciles and promotes once, and starts the clocks."""
        self.recover()
        self.promote()
        self._started = self._promoted = self._recovered = self.clock()
        self.processed = 0

    def maintain(self) -> None:
        """What is due of promotion and recovery, each by its own interval."""
        now = self.clock()
        if now - self._promoted >= self.options.promote_interval:
            self.promote()
            self._promoted = now
        if now - self._recovered >= self.options.recovery_interval:
            self.recover()
            self._recovered = now

    def promote(self) -> None:
        def change(tables):
            rows = tables["notifications"].where(F.col("queue") == self.queue)
            moved = notify.promote_delayed(rows, self._now(), self.options.promote_limit, notify.next_seq(tables["notifications"])).where("moved")
            return {"notifications": (moved, _before(moved, "delayed"))}

        self.store.transact(change, "promote")

    def recover(self, limit: int = 100) -> None:
        """Stale leases and stale processing notifications of the queue, then one
        page of reconciliation from where the last one ended."""

        def change(tables):
            now, ttl = self._now(), self.options.stuck_job_ttl
            jobs = recovery.recover_stale_in_queue(tables["jobs"], self.queue, ttl, limit, now).where("affected = 1").drop("affected")
            notes = tables["notifications"].where(F.col("queue") == self.queue)
            moved = recovery.move(notes, F.coalesce((F.col("list") == "processing") & (F.col("score") <= recovery.before(now, ttl)), F.lit(False)), "pending", limit, notify.next_seq(tables["notifications"]))
            moved = moved.where("moved")
            return {"jobs": (jobs, None), "notifications": (moved, _before(moved, "processing"))}

        self.store.transact(change, "recover")

        def mend(tables):
            done = reconcile(tables["jobs"], tables["notifications"], self.queue, self._now(), self.cursor, ReconcileOptions())
            self.cursor = done.cursor
            return {"notifications": (done.restored, None)}

        self.store.transact(mend, "reconcile")

    def step(self, most: int | None = None) -> int:
        """One batch of at most ``most`` jobs; how many were claimed.  The
        listener hears of a batch when it is committed."""
        most = self.most if most is None else most
        if self.options.max_jobs:
            most = min(most, self.options.max_jobs - self.processed)
        began, heard, n = time.perf_counter(), [], 0

        def change(tables):
            nonlocal n, heard
            jobs, notes = (tables[t].where(F.col("queue") == self.queue) for t in ("jobs", "notifications"))
            latency = (time.perf_counter() - began) * 1000
            done = run_batch(jobs, notes, self.handlers, self._now(), most, self.name, self.options, tables["version"] + 1, latency, self.store.keep)
            heard, n = [done.events], done.jobs.count()
            return {"jobs": (done.jobs, None), "notifications": (done.after, done.before)}

        self.store.transact(change, "batch", tries=1)
        self.processed += n
        if self.listener and n:
            events.listen(heard, self.listener)
        return n

    def process_one(self) -> bool:
        """Promotes, then runs one job; False where none is due or it cannot be claimed."""
        self.promote()
        try:
            return self.step(1) > 0
        except Exception:  # noqa: BLE001  the next call tries again
            return False

    def failed(self, error: Exception) -> float:
        """Counts an infrastructure error, tells of it, and says how long to wait:
        longer each time; any other error waits a second and does not count."""
        if not is_infrastructure(error):
            return 1.0
        self.errors += 1
        wait = backoff_seconds(self.errors, self.options) + random.random()
        if self.listener:
            events.listen([events.loop_failure(self.store.spark, str(error), type(error).__name__, wait)], self.listener)
        return wait

    def run(self) -> int:
        """Batches until a limit is reached or, with ``stop_when_empty``, nothing
        is left; how many jobs were run.  A good batch ends a run of errors."""
        self.start()
        while not self.limits_reached():
            self.maintain()
            try:
                n, self.errors = self.step(), 0
            except Exception as error:  # noqa: BLE001
                self.sleep(self.failed(error))
                continue
            if not n:
                if self.options.stop_when_empty:
                    break
                self.sleep(self.options.poll_timeout)
        return self.processed
