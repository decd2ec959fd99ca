"""Creation of jobs: single, batch, scheduled and idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import after, is_active, moment
from ..schema import JOB_COLUMNS, JOB_SCHEMA, PENDING


def numbered(rows: DataFrame, order: str, first: int, name: str = "id", block: int = 1 << 16, by: str | None = None) -> DataFrame:
    """``rows`` with contiguous numbers from ``first`` by ``order``, whose
    integers must be distinct; ``by``: in each of its groups, null among them.

    Rows are ranked within blocks of ``block`` integers, so no task ranks more
    than that, however many rows a group has; a running sum over the blocks'
    counts, one row each, joins them.
    """
    groups = [] if by is None else [by]
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocked.groupBy(*groups, "_block").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*groups).orderBy("_block")
    starts = counts.select(*(F.col(c).alias("_by") for c in groups), F.col("_block").alias("_at"), (F.sum("_n").over(over) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_block").orderBy(order))
    met = F.col("_block") == F.col("_at")
    for c in groups:
        met &= F.col(c).eqNullSafe(F.col("_by"))
    joined = blocked.withColumn("_rank", rank).join(starts, met)
    return joined.withColumn(name, (F.col("_before") + F.col("_rank") - 1 + first).cast("long")).drop("_block", "_rank", "_before", "_at", "_by")


def available_at(time: Column, now: Column) -> Column:
    """When a job is due: the given UTC time, now where that is past or null."""
    return F.when(time > now, time).otherwise(now)


def from_epoch(seconds: Column) -> Column:
    """A UTC time from seconds since 1970; others than positive ones fail the
    row, null stays null."""
    wrong = F.raise_error(F.lit("a time must be positive seconds since 1970")).cast("timestamp_ntz")
    return F.when(seconds <= 0, wrong).otherwise(after(moment("1970-01-01 00:00:00"), seconds))


def definition_error() -> Column:
    """What is wrong with a definition, else null."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("x"))) == ""
    return (
        F.when(F.col("type").isNull() | blank("type"), "type must not be blank").when(blank("queue"), "queue must not be blank").when(F.col("max_attempts") < 1, "max_attempts must be at least 1").when(blank("request_id"), "request_id must not be blank")
    )


def _completed(definitions: DataFrame) -> DataFrame:
    have, defaults = set(definitions.columns), {"queue": "default", "max_attempts": 3, "payload": "{}"}
    for name in ("type", "queue", "payload", "max_attempts", "request_id", "available_at"):
        kind = JOB_SCHEMA[name].dataType
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        definitions = definitions.withColumn(name, F.coalesce(value, F.lit(defaults[name])) if name in defaults else value)
    return definitions


def create_jobs(jobs: DataFrame, definitions: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """The pending rows of a batch, ids contiguous from the ledger's greatest in
    the order of ``definitions``.  One ``now`` holds for the batch; a bad
    definition fails the whole batch."""
    ready = _completed(definitions)
    bad = ready.withColumn("_error", definition_error()).where("_error IS NOT NULL").select("_error").limit(1).collect()
    if bad:
        raise ValueError(bad[0][0])
    first = (jobs.agg(F.max("id")).first()[0] or 0) + 1
    rows = numbered(ready, order, first)
    filled = {"status": F.lit(PENDING), "attempts": F.lit(0), "available_at": available_at(F.col("available_at"), now), "created_at": now, "updated_at": now}
    return rows.select(*(filled.get(c, F.col(c) if c in ("id", "queue", "type", "payload", "max_attempts", "request_id") else F.lit(None)).cast(JOB_SCHEMA[c].dataType).alias(c) for c in JOB_COLUMNS))


def dispatch_list(time: Column, now: Column) -> Column:
    """Which list a new job's notification goes to."""
    return F.when(time > now, "delayed").otherwise("pending")


def dispatch_after(now: Column, seconds: Column) -> Column:
    """The time of a delay in seconds; a negative one fails the row."""
    return F.when(seconds < 0, F.raise_error(F.lit("delay must not be negative"))).otherwise(after(now, seconds))


def idempotent(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(seq, request_id, ...)`` with job_id and created.

    A pending or running job of the request id (the least id, if the ledger has
    several) answers it.  Of the requests that none answers, the first by seq
    of each request id creates a job and the others get that job; new ids are
    contiguous from the greatest, by seq.
    """
    active = jobs.where(is_active(F.col("status")) & F.col("request_id").isNotNull()).groupBy("request_id").agg(F.min("id").alias("active_id"))
    met = requests.join(active, "request_id", "left")
    # a request id's first is a partial aggregate: a hot one is a row per task
    makers = met.where("active_id IS NULL").groupBy("request_id").agg(F.min("seq").alias("maker"))
    first = (jobs.agg(F.max("id")).first()[0] or 0) + 1
    makers = numbered(makers, "maker", first, "new_id")
    out = met.join(makers, "request_id", "left")
    return out.select(*requests.columns, F.coalesce("active_id", "new_id").alias("job_id"), (F.col("active_id").isNull() & (F.col("seq") == F.col("maker"))).alias("created"))

