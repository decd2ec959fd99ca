"""Recovery by age: stale leases, stale and unstamped notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import before
from ..schema import FAILED, PENDING, RUNNING, STALE_MESSAGE
from .transitions import _RELEASE, _changed


def recover_stale(jobs: DataFrame, ttl: int, now: Column) -> DataFrame:
    """Running jobs locked more than ``ttl`` seconds ago: failed where one more
    attempt would be the last, else pending with one attempt more."""
    _positive(ttl)
    stale = F.coalesce((F.col("status") == RUNNING) & (F.col("locked_at") < before(now, ttl)), F.lit(False))
    last = F.col("attempts") + 1 >= F.col("max_attempts")
    free = {c: F.lit(None) for c in _RELEASE} | {"updated_at": now}
    rows = jobs.withColumn("affected", stale.cast("int"))
    return _changed(
        rows, jobs.columns,
        [
            (stale & last, {"status": F.lit(FAILED), "error_message": F.lit(STALE_MESSAGE), "completed_at": now, **free}),
            (stale, {"status": F.lit(PENDING), "attempts": F.col("attempts") + 1, "available_at": now, **free}),
        ],
    )


def recover_stale_in_queue(jobs: DataFrame, queue: str, ttl: int, limit: int, now: Column) -> DataFrame:
    """As :func:`recover_stale` for one queue and its ``limit`` oldest leases;
    every one gets one attempt more and is due now, also where it has failed."""
    _positive(ttl, limit)
    stale = (F.col("status") == RUNNING) & (F.col("queue") == queue) & (F.col("locked_at") < before(now, ttl))
    chosen = jobs.where(stale).orderBy("locked_at", "id").limit(limit).select("id", F.lit(1).alias("affected"))
    rows = jobs.join(chosen, "id", "left").withColumn("affected", F.coalesce("affected", F.lit(0)))
    hit, last = F.col("affected") == 1, F.col("attempts") + 1 >= F.col("max_attempts")
    new = {"status": F.when(last, FAILED).otherwise(PENDING), "attempts": F.col("attempts") + 1, "available_at": now, "completed_at": F.when(last, now).otherwise(F.col("completed_at")), "updated_at": now}
    return _changed(rows, jobs.columns, [(hit, new | {c: F.lit(None) for c in _RELEASE})])


def recover_stale_processing(notifications: DataFrame, ttl: int, now: Column, limit: int = 100) -> DataFrame:
    """Of each queue the ``limit`` oldest processing notifications stamped at
    least ``ttl`` seconds ago go back to pending, behind all that wait there;
    ``moved`` tells which."""
    _positive(ttl, limit)
    old = F.coalesce((F.col("list") == "processing") & (F.col("score") <= before(now, ttl)), F.lit(False))
    return move(notifications, old, "pending", limit)


def repair_unscored(notifications: DataFrame, now: Column, slice_size: int, after_id: int = 0) -> DataFrame:
    """Stamps unstamped processing notifications of a slice by id in each queue."""
    at = Window.partitionBy("queue").orderBy("job_id", "seq")
    picked = notifications.where((F.col("list") == "processing") & (F.col("job_id") > after_id)).select(*PLACE, F.row_number().over(at).alias("r"))
    picked = picked.where(F.col("r") <= slice_size).select(*PLACE, F.lit(True).alias("_in"))
    rows = notifications.join(picked, PLACE, "left")
    hit = F.coalesce(F.col("_in") & F.col("score").isNull(), F.lit(False))
    return rows.select(*(F.when(hit, now).otherwise(F.col("score")).alias("score") if c == "score" else F.col(c) for c in notifications.columns), hit.alias("repaired"))


#: What tells notifications apart: a list may hold an id more than once.
PLACE = ["queue", "job_id", "list", "seq"]


def next_seq(notifications: DataFrame) -> int:
    return (notifications.agg(F.max("seq")).first()[0] or 0) + 1


def move(notifications: DataFrame, which: Column, to: str, limit: int, first_seq: int | None = None) -> DataFrame:
    """The first rows of each queue by score and then by id as text change list,
    and come last there: in that order they get the numbers after all others, or
    from ``first_seq`` on; ``was`` is the number before."""
    first_seq = next_seq(notifications) if first_seq is None else first_seq
    order = Window.partitionBy("queue").orderBy("score", F.col("job_id").cast("string"), "seq")
    first = notifications.where(which).select(*PLACE, F.row_number().over(order).alias("_r")).where(F.col("_r") <= limit)
    rows = notifications.join(first, PLACE, "left")
    hit = F.col("_r").isNotNull()
    new = {"list": F.when(hit, to).otherwise(F.col("list")), "score": F.when(~hit, F.col("score")), "seq": F.when(hit, F.lit(first_seq - 1) + F.col("_r")).otherwise(F.col("seq"))}
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in notifications.columns), hit.alias("moved"), F.col("seq").alias("was"))


def _positive(*values: int) -> None:
    if min(values) < 1:
        raise ValueError("ttl and limit must be positive")
