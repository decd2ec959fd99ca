"""The ledger's columns, defaults and states."""

from __future__ import annotations

from pyspark.sql import types as T

PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"
STATUSES = (PENDING, RUNNING, COMPLETED, FAILED, CANCELLED)
TERMINAL = (COMPLETED, FAILED, CANCELLED)
ACTIVE = (PENDING, RUNNING)

_TIME = T.TimestampNTZType()
JOB_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("id", T.LongType()), ("queue", T.StringType()), ("type", T.StringType()), ("status", T.StringType()), ("payload", T.StringType()),
            ("attempts", T.IntegerType()), ("max_attempts", T.IntegerType()), ("available_at", _TIME), ("started_at", _TIME), ("completed_at", _TIME),
            ("locked_by", T.StringType()), ("locked_at", _TIME), ("lease_token", T.StringType()), ("error_message", T.StringType()), ("error_trace", T.StringType()),
            ("progress", T.IntegerType()), ("progress_message", T.StringType()), ("result", T.StringType()), ("request_id", T.StringType()), ("created_at", _TIME), ("updated_at", _TIME),
        )
    ]
)
JOB_COLUMNS = JOB_SCHEMA.names
#: What a null in a raw row stands for.
DEFAULTS = {"queue": "default", "status": PENDING, "payload": "{}", "attempts": 0, "max_attempts": 3}

NOTIFICATION_SCHEMA = T.StructType([T.StructField("queue", T.StringType()), T.StructField("job_id", T.LongType()), T.StructField("list", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("score", _TIME)])

#: Fixed message of a job that was abandoned too often.
STALE_MESSAGE = "Job timed out / worker crashed (stale recovery)"
EVENTS = {
    "claimed": ("job_id", "type", "acquire_latency_ms"),
    "completed": ("job_id", "type", "duration_ms"),
    "retried": ("job_id", "type", "duration_ms", "attempts", "error"),
    "failed": ("job_id", "type", "duration_ms", "error"),
    "lost_ownership": ("job_id", "type", "context"),
    "infrastructure_failure": ("job_id", "context"),
    "infra_error": ("error", "exception_class"),
    "backoff": ("error", "backoff_seconds"),
}


class LedgerError(Exception):
    """Base of the engine's errors."""


class SerializationError(LedgerError):
    """A payload or result is not the JSON that it must be."""


class HandlerMissing(LedgerError):
    """No handler is registered for a type."""


class ModeUnavailable(LedgerError):
    """The asked-for notification mode has no table."""


class CommitConflict(LedgerError):
    """Another writer has committed this version of the ledger."""
