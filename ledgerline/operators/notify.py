"""Notification collections: pending, processing and delayed ids of a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import after, valid_job_id
from ..schema import NOTIFICATION_SCHEMA
from .ingest import numbered
from .recovery import PLACE, move, next_seq

_COLUMNS = NOTIFICATION_SCHEMA.names


def enqueue(notifications: DataFrame, new: DataFrame) -> DataFrame:
    """``new(queue, job_id, seq)`` to the pending lists, which may hold an id
    more than once."""
    rows = new.select("queue", "job_id", F.lit("pending").alias("list"), "seq", F.lit(None).cast("timestamp_ntz").alias("score"))
    return notifications.select(*_COLUMNS).unionByName(rows)


def enqueue_delayed(notifications: DataFrame, new: DataFrame) -> DataFrame:
    """``new(queue, job_id, seq, score)`` to the delayed sets: an id has one score,
    the last one given."""
    best = new.groupBy("queue", "job_id").agg(F.max(F.struct("seq", "score")).alias("b"))
    rows = best.select("queue", "job_id", F.lit("delayed").alias("list"), F.col("b.seq").alias("seq"), F.col("b.score").alias("score"))
    kept = notifications.join(rows.select("queue", "job_id", "list"), ["queue", "job_id", "list"], "left_anti")
    return kept.select(*_COLUMNS).unionByName(rows)


def oldest_pending(notifications: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of each pending list that are dequeued first."""
    order = Window.partitionBy("queue").orderBy("seq", "job_id")
    rows = notifications.where(F.col("list") == "pending").withColumn("_r", F.row_number().over(order))
    return rows.where(F.col("_r") <= most).select(*_COLUMNS)


def dequeue(notifications: DataFrame, most: int, now: Column) -> DataFrame:
    """The oldest pending ids of each queue go to processing, stamped now."""
    rows = notifications.join(oldest_pending(notifications, most).select(*PLACE, F.lit(True).alias("_hit")), PLACE, "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {"list": F.when(hit, "processing").otherwise(F.col("list")), "score": F.when(hit, now).otherwise(F.col("score"))}
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in _COLUMNS), hit.alias("moved"))


def _held(notifications: DataFrame, ids: DataFrame) -> DataFrame:
    """The place of the oldest processing occurrence of each of ``ids(queue, job_id)``."""
    rows = notifications.where(F.col("list") == "processing").join(ids.select("queue", "job_id"), ["queue", "job_id"], "left_semi")
    return rows.groupBy("queue", "job_id", "list").agg(F.min("seq").alias("seq"))


def ack(notifications: DataFrame, ids: DataFrame) -> DataFrame:
    """Without one processing occurrence of each of ``ids(queue, job_id)``; an id
    that is asked for twice counts once.  Only what is asked for is aggregated."""
    return notifications.join(_held(notifications, ids), PLACE, "left_anti").select(*_COLUMNS)


def nack(notifications: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One processing occurrence of each of ``ids(queue, job_id, delay)`` leaves:
    for delayed, due in so many seconds, in place of the id's row there, or,
    where delay is 0, for the end of the pending list.

    Of repeated requests the shortest delay counts; those for one queue come in
    order of their ids.
    """
    wait = F.when(F.col("delay") < 0, F.raise_error(F.lit("delay must not be negative")).cast("int")).otherwise(F.col("delay"))
    asked = ids.select("queue", "job_id", wait.alias("_delay")).groupBy("queue", "job_id").agg(F.min("_delay").alias("_delay"))
    picked = numbered(_held(notifications, asked).join(asked, ["queue", "job_id"]), "job_id", next_seq(notifications), "_next", by="queue")
    late = picked.where("_delay > 0").select("queue", "job_id", F.lit("delayed").alias("list"))
    rows = notifications.join(late, ["queue", "job_id", "list"], "left_anti").join(picked, PLACE, "left")
    hit, later = F.col("_next").isNotNull(), F.col("_delay") > 0
    new = {
        "list": F.when(hit & later, "delayed").when(hit, "pending").otherwise(F.col("list")),
        "score": F.when(hit & later, after(now, F.col("_delay"))).when(~hit, F.col("score")),
        "seq": F.when(hit, F.col("_next")).otherwise(F.col("seq")),
    }
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in _COLUMNS), hit.alias("moved"))


def promote_delayed(notifications: DataFrame, now: Column, limit: int = 100, next_seq: int | None = None) -> DataFrame:
    """Of each queue the first ``limit`` delayed ids that are due go to the end of pending."""
    return move(notifications, F.coalesce((F.col("list") == "delayed") & (F.col("score") <= now), F.lit(False)), "pending", limit, next_seq)


def remove(notifications: DataFrame, ids: DataFrame) -> DataFrame:
    """Without ``ids(queue, job_id)``, from every list."""
    return notifications.join(ids.select("queue", "job_id"), ["queue", "job_id"], "left_anti").select(*_COLUMNS)


def heartbeat(notifications: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Stamps the processing notifications of ``ids`` anew."""
    rows = notifications.join(ids.select("queue", "job_id").distinct().withColumn("_hit", F.lit(True)), ["queue", "job_id"], "left")
    hit = F.coalesce(F.col("_hit") & (F.col("list") == "processing"), F.lit(False))
    return rows.select(*(F.when(hit, now).otherwise(F.col("score")).alias("score") if c == "score" else F.col(c) for c in _COLUMNS))


def newest_pending(notifications: DataFrame, most: int) -> DataFrame:
    """Ids among the newest ``most`` of each pending list; others may be there
    unseen, which is what bounds the look."""
    order = Window.partitionBy("queue").orderBy(F.desc("seq"), F.desc("job_id"))
    rows = notifications.where(F.col("list") == "pending").select("queue", "job_id", "seq", F.row_number().over(order).alias("r"))
    return rows.where(F.col("r") <= most).select("queue", "job_id").distinct()


def has_delayed(notifications: DataFrame, ids: DataFrame) -> DataFrame:
    """Of ``ids(queue, job_id)`` those that the delayed sets hold."""
    delayed = notifications.where(F.col("list") == "delayed").select("queue", "job_id")
    return ids.join(delayed, ["queue", "job_id"], "left_semi")


def clear(notifications: DataFrame, queue: str | None = None) -> DataFrame:
    """Without the notifications of a queue, or of all where it is None."""
    return notifications.where(F.lit(False) if queue is None else F.col("queue") != queue)


def stats(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("queue").agg(*(F.count(F.when(F.col("list") == x, 1)).alias(x) for x in ("pending", "processing", "delayed")))


def listing(notifications: DataFrame, queue: str, which: str) -> DataFrame:
    """A list's ids, the newest first."""
    return notifications.where((F.col("queue") == queue) & (F.col("list") == which)).orderBy(F.desc("seq")).select("job_id", "seq")


def split_malformed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw(queue, raw_id, ...)``: rows with a valid job_id, and those to discard."""
    rows = raw.withColumn("job_id", valid_job_id(F.col("raw_id")))
    return rows.where("job_id IS NOT NULL"), rows.where("job_id IS NULL").drop("job_id")


def derived(jobs: DataFrame, now: Column) -> DataFrame:
    """Notifications as a view of the ledger: what is pending, due or not."""
    which = F.when(F.col("available_at") <= now, "pending").otherwise("delayed")
    rows = jobs.where(F.col("status") == "pending")
    return rows.select("queue", F.col("id").alias("job_id"), which.alias("list"), F.col("id").alias("seq"), F.when(which == "delayed", F.col("available_at")).alias("score"))
