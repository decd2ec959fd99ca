"""Ordered claims with leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PENDING, RUNNING


def lease_token(job_id: Column, worker: Column, version: int) -> Column:
    """64 hexadecimal digits that stay the same when a task runs again."""
    return F.sha2(F.concat_ws("|", job_id.cast("string"), worker, F.lit(str(version))), 256)


def due(now: Column, queue: str | None = None) -> Column:
    keep = (F.col("status") == PENDING) & (F.col("available_at") <= now)
    return keep if queue is None else keep & (F.col("queue") == queue)


def claim_next(jobs: DataFrame, now: Column, most: int, workers: int = 1, version: int = 1) -> DataFrame:
    """Claims ``(id, queue, rank, worker_id, lease_token)`` of the ``most`` jobs of
    each queue that are due first, dealt to the workers in turn.

    Each task keeps its own first ``most`` rows of a queue before the shuffle.
    """
    order = Window.partitionBy("queue").orderBy("available_at", "id")
    ranked = jobs.where(due(now)).select("id", "queue", "available_at", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)
    worker = F.concat(F.lit("worker-"), ((F.col("rank") - 1) % workers).cast("string"))
    return ranked.select("id", "queue", "rank", worker.alias("worker_id"), lease_token(F.col("id"), worker, version).alias("lease_token"))


def claim_by_id(jobs: DataFrame, requests: DataFrame, now: Column, version: int = 1) -> DataFrame:
    """Claims for ``requests(id, worker_id)``: of due pending jobs, and of running
    ones that the same worker holds, whose new token fences the old one."""
    met = jobs.join(requests.select("id", "worker_id"), "id")
    free = due(now) | ((F.col("status") == RUNNING) & (F.col("locked_by") == F.col("worker_id")))
    return met.where(free).select("id", "queue", "worker_id", lease_token(F.col("id"), F.col("worker_id"), version).alias("lease_token"))


def apply_claims(jobs: DataFrame, claims: DataFrame, now: Column, touched: bool = False) -> DataFrame:
    """The ledger after these claims; attempts stay as they are.  ``touched``:
    the claimed jobs alone, as changes to commit."""
    taken = claims.select("id", F.col("worker_id").alias("_worker"), F.col("lease_token").alias("_token"))
    mine = F.col("_token").isNotNull()
    new = {"status": F.lit(RUNNING), "locked_by": F.col("_worker"), "lease_token": F.col("_token"), "locked_at": now, "started_at": now, "updated_at": now}
    return jobs.join(taken, "id", "inner" if touched else "left").select(*(F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns))
