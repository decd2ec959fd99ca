"""Reconciliation: pending jobs whose notification is missing get one."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import ReconcileOptions
from .notify import newest_pending
from .recovery import next_seq
from .reads import scan_pending


def outcomes(page: DataFrame, notifications: DataFrame, now: Column, membership_limit: int) -> DataFrame:
    """``page`` with expected list and outcome: invalid, duplicate or restored.

    A due job is looked for among the newest ids of its pending list, any other
    in the delayed set; one found elsewhere only still counts as missing.
    """
    due = F.coalesce(F.col("available_at"), now) <= now
    page = page.withColumn("expected", F.when(due, "pending").otherwise("delayed"))
    known = newest_pending(notifications, membership_limit).withColumn("expected", F.lit("pending"))
    delayed = notifications.where(F.col("list") == "delayed").select("queue", "job_id").distinct().withColumn("expected", F.lit("delayed"))
    known = known.unionByName(delayed).select("queue", F.col("job_id").alias("id"), "expected", F.lit(True).alias("_known"))
    rows = page.join(known, ["queue", "id", "expected"], "left")
    outcome = F.when(F.col("id") < 1, "invalid").when(F.col("_known"), "duplicate").otherwise("restored")
    return rows.withColumn("outcome", outcome).drop("_known")


@dataclass(frozen=True)
class Reconciled:
    rows: DataFrame  # of the page, with their outcomes
    restored: DataFrame  # notifications to be appended
    notifications: DataFrame  # with what was restored
    cursor: int | None
    scanned: int


def reconcile(
    jobs: DataFrame, notifications: DataFrame, queue: str, now: Column, cursor: int | None = None, options: ReconcileOptions | None = None,
    clock: Callable[[], float] = time.monotonic, step: int | None = None,
) -> Reconciled:
    """One page from ``cursor``.  An empty page after a cursor begins anew once;
    the next cursor is None when a page came short of its size.

    The page goes in parts of ``step`` jobs (without: whole); before each the
    ``clock`` is read, and once the options' time limit is over the rest stays
    for the next call, whose cursor is the last job that was looked at.  The
    time begins when the page is there: to read it is a job of the cluster, and
    one that takes longer than the limit would leave the page for ever.
    """
    options = options or ReconcileOptions()
    page = scan_pending(jobs, queue, cursor, options.page_size)
    ids = [r.id for r in page.select("id").collect()]  # at most a page
    if not ids and cursor is not None:
        cursor = None
        page = scan_pending(jobs, queue, None, options.page_size)
        ids = [r.id for r in page.select("id").collect()]
    began, done = clock(), 0
    while done < len(ids) and clock() - began < options.time_limit:
        done = min(len(ids), done + (step or len(ids)))
    rows = outcomes(page.where(F.col("id") <= ids[done - 1]) if done else page.limit(0), notifications, now, options.membership_limit)
    new = rows.where(F.col("outcome") == "restored").select("queue", F.col("id").alias("job_id"), F.col("expected").alias("list"), F.when(F.col("expected") == "delayed", F.col("available_at")).alias("score"))
    seq = F.lit(next_seq(notifications) - 1) + F.row_number().over(Window.partitionBy("queue").orderBy("job_id"))
    restored = new.withColumn("seq", seq.cast("long")).select(*notifications.columns)
    after = None if done == len(ids) < options.page_size else ids[done - 1] if done else cursor
    return Reconciled(rows, restored, notifications.unionByName(restored), after, done)


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))
