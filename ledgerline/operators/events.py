"""The events of a worker: one schema, the fields that each kind has, a listener."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENTS

#: Column: its type.
FIELDS = {
    "job_id": "long", "type": "string", "acquire_latency_ms": "double", "duration_ms": "double", "attempts": "int",
    "error": "string", "context": "string", "exception_class": "string", "backoff_seconds": "double",
}


def event(rows: DataFrame, kind: str | Column, **values: Column) -> DataFrame:
    """``rows`` as events; what is not given is null."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(name.alias("event"), *(values.get(c, F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()))


def claimed(jobs: DataFrame, latency_ms: float) -> DataFrame:
    return event(jobs, "claimed", job_id=F.col("id"), type=F.col("type"), acquire_latency_ms=F.lit(latency_ms))


def settled(requests: DataFrame, jobs: DataFrame, affected: DataFrame) -> DataFrame:
    """What each of ``requests(id, kind, attempts, error, duration_ms, bad_result)``
    did, or that its owner had lost the job.  A result that is no JSON fails its
    job without an event."""
    met = requests.where(~F.coalesce(F.col("bad_result"), F.lit(False))).join(jobs.select("id", "type"), "id").join(affected.select("id", "affected"), "id")
    named = F.create_map(*(F.lit(x) for x in ("complete", "completed", "retry", "retried", "fail", "failed")))
    kind = F.when(F.col("affected") == 1, named[F.col("kind")]).otherwise("lost_ownership")
    lost = kind == "lost_ownership"
    return event(
        met, kind, job_id=F.col("id"), type=F.col("type"), duration_ms=F.when(~lost, F.col("duration_ms")), attempts=F.when(kind == "retried", F.col("attempts")),
        error=F.when(kind.isin("retried", "failed"), F.col("error")), context=F.when(lost, F.col("kind")),
    )


def heartbeat_failures(rows: DataFrame) -> DataFrame:
    """Of ``rows(id)`` whose progress was kept but whose notification was not refreshed."""
    return event(rows, "infrastructure_failure", job_id=F.col("id"), context=F.lit("processing_heartbeat"))


def loop_failure(spark: SparkSession, error: str, exception_class: str, backoff_seconds: float) -> DataFrame:
    """The two events of a worker that an infrastructure error has stopped for a while."""
    one = spark.range(1)
    return event(one, "infra_error", error=F.lit(error), exception_class=F.lit(exception_class)).unionByName(event(one, "backoff", error=F.lit(error), backoff_seconds=F.lit(backoff_seconds)))


def event_error() -> Column:
    """What is wrong with an event, else null: an unknown kind, a field that its
    kind must have, or one that it must not."""
    out = F.when(~F.coalesce(F.col("event").isin(*EVENTS), F.lit(False)), F.lit("unknown event"))
    for kind, fields in EVENTS.items():
        missing = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in fields))
        more = F.concat_ws(",", *(F.when(F.col(c).isNotNull(), F.lit(c)) for c in FIELDS if c not in fields))
        here = F.col("event") == kind
        out = out.when(here & (missing != ""), F.concat(F.lit("without "), missing)).when(here & (more != ""), F.concat(F.lit("with "), more))
    return out


def records(events: DataFrame) -> DataFrame:
    """event, and its fields as one JSON object in a fixed order; nulls left out."""
    return events.select("event", F.to_json(F.struct(*FIELDS)).alias("fields"))


def listen(events: list[DataFrame], listener: Callable[[dict], None]) -> None:
    """Hands a micro-batch's events to ``listener``, one after another; they are
    as many as the batch's jobs and more do not come to the driver."""
    for row in reduce(DataFrame.unionByName, events).toLocalIterator():
        listener({"event": row.event} | {c: row[c] for c in EVENTS[row.event]})
