"""Dispatch and administration: the ledger and its notifications together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import check_dispatch
from ..schema import CANCELLED, FAILED, NOTIFICATION_SCHEMA
from .ingest import create_jobs, dispatch_list, idempotent, numbered
from .notify import next_seq, remove
from .transitions import cancel, purge_failed, requeue_failed

_NOTE = NOTIFICATION_SCHEMA.names


@dataclass(frozen=True)
class Dispatched:
    """New rows of the ledger and of the notifications, to be appended."""

    jobs: DataFrame
    notifications: DataFrame


def notified(new: DataFrame, notifications: DataFrame, now: Column) -> DataFrame:
    """A notification for each new job: delayed until it is due, or else pending,
    behind all that wait, in order of the ids."""
    which = dispatch_list(F.col("available_at"), now)
    rows = new.select("queue", F.col("id").alias("job_id"), which.alias("list"), F.when(which == "delayed", F.col("available_at")).alias("score"))
    return numbered(rows, "job_id", next_seq(notifications), "seq", by="queue").select(*_NOTE)


def dispatch(jobs: DataFrame, notifications: DataFrame, definitions: DataFrame, now: Column, order: str = "seq") -> Dispatched:
    """Checks, creates and notifies: a bad definition fails the whole batch
    before anything is made.  ``definitions`` are those of ``create_jobs``."""
    new = create_jobs(jobs, definitions, now, order)
    return Dispatched(new, notified(new, notifications, now))


def dispatch_batch(jobs: DataFrame, notifications: DataFrame, payloads: DataFrame, kind: str, now: Column, queue: str = "default", max_attempts: int = 3, due: Column | None = None) -> Dispatched:
    """``payloads(seq, payload)`` as jobs of one type, queue and number of
    attempts, without request ids; all due at ``due``, or now."""
    check_dispatch(kind, queue, max_attempts)
    made = payloads.select("seq", "payload", F.lit(kind).alias("type"), F.lit(queue).alias("queue"), F.lit(max_attempts).alias("max_attempts"))
    return dispatch(jobs, notifications, made if due is None else made.withColumn("available_at", due), now)


def dispatch_idempotent(jobs: DataFrame, notifications: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, Dispatched]:
    """The answers of ``ingest.idempotent``, and what they create: only a new
    job is notified."""
    answers = idempotent(jobs, requests)
    made = answers.where("created").select(F.col("job_id").alias("seq"), *(c for c in requests.columns if c != "seq"))
    return answers, dispatch(jobs, notifications, made, now)


def _places(jobs: DataFrame, ids: DataFrame, when: Column) -> DataFrame:
    return jobs.where(when).join(ids.select("id").distinct(), "id", "left_semi").select("queue", F.col("id").alias("job_id"))


def cancel_jobs(jobs: DataFrame, notifications: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The ledger after ``cancel``, and the notifications without those of the
    ids that are cancelled now or were before: so asking again mends a removal
    that did not happen."""
    after = cancel(jobs, ids, now)
    return after, remove(notifications, _places(after, ids, F.col("status") == CANCELLED))


def requeue_jobs(jobs: DataFrame, notifications: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The ledger after ``requeue_failed``, and the notifications with a pending
    one for each job that had failed."""
    after = requeue_failed(jobs, ids, now)
    again = after.where("affected = 1").select("id", "queue", "available_at")
    return after, notifications.select(*_NOTE).unionByName(notified(again, notifications, now))


def purge_jobs(jobs: DataFrame, notifications: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger without those of ``ids`` that have failed, and the
    notifications without theirs."""
    return purge_failed(jobs, ids), remove(notifications, _places(jobs, ids, F.col("status") == FAILED))
