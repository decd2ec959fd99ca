"""Policies as column expressions, and configuration with its checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ACTIVE, TERMINAL


def moment(value: str | Column) -> Column:
    """A UTC time without zone, from text or a column."""
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp_ntz")


def after(time: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def before(time: Column, seconds: Column | int) -> Column:
    return after(time, -seconds)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def can_retry(attempts: Column, max_attempts: Column) -> Column:
    return attempts < max_attempts


def retry_decision(attempts: Column, max_attempts: Column) -> Column:
    """What a failed execution leads to, attempts being those before it."""
    return F.when(attempts + 1 < max_attempts, "retry").otherwise("fail")


def delay(base: int, exponent: Column, cap: int) -> Column:
    """``base ** exponent`` whole seconds, ``cap`` where that is reached."""
    power = F.pow(F.lit(float(base)), exponent.cast("double"))
    return F.when(F.isnan(power) | (power >= cap), cap).otherwise(power).cast("int")


def ownership(owned: Column) -> Column:
    return F.when(owned, "owned").otherwise("lost")


def progress_valid(progress: Column) -> Column:
    return progress.isNull() | progress.between(0, 100)


def short_trace(trace: Column, most: int = 4000) -> Column:
    return F.when(F.length(trace) > most, F.concat(F.substring(trace, 1, most), F.lit("\n... [truncated]"))).otherwise(trace)


def lock_name(queue: Column) -> Column:
    return F.regexp_replace(queue, "[^a-zA-Z0-9_-]", "")


def worker_id(host: Column, pid: Column) -> Column:
    return F.concat_ws(":", host, pid.cast("string"))


def valid_job_id(raw: Column) -> Column:
    """The id that a raw notification stands for; null if it is malformed."""
    return F.when(raw.rlike("^[1-9][0-9]*$"), raw.try_cast("bigint"))


def parsed_time(raw: Column, now: Column) -> Column:
    """A strict ``Y-m-d H:i:s`` time, else any time that Spark reads, else now."""
    return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"), raw.try_cast("timestamp_ntz"), now)


def payload_object(payload: Column) -> Column:
    """Whether a payload is a JSON object; an empty list counts as one."""
    return F.coalesce((F.json_object_keys(payload).isNotNull()) | (F.trim(payload) == "[]"), F.lit(False))


def infrastructure_error(class_name: Column) -> Column:
    """Whether an exception's class is one of the store or transport layers."""
    name = F.element_at(F.split(class_name, r"\."), -1)
    return class_name.startswith("py4j.") | class_name.startswith("pyspark.errors.exceptions.connect") | name.isin("ConnectionError", "ConnectionResetError", "BrokenPipeError", "TimeoutError", "OperationalError", "InterfaceError", "RedisError")


#: Exceptions of the store or transport, as a worker meets them.
_INFRASTRUCTURE = (ConnectionError, TimeoutError, OSError)


def is_infrastructure(error: BaseException) -> bool:
    """As :func:`infrastructure_error`, of an exception itself."""
    return isinstance(error, _INFRASTRUCTURE) or type(error).__module__.startswith("py4j.") or type(error).__name__ in ("OperationalError", "InterfaceError", "CommitConflict")


def backoff_seconds(errors: int, options: WorkerOptions) -> float:
    """Seconds to wait after so many errors in a row: doubled each time, to the cap."""
    return float(min(options.retry_max_delay, options.retry_base_delay**errors))


#: Codes and parts of messages by which a lost connection is told; fixed values.
LOST_CODES = ("2006", "2013", "08003", "08006")
LOST_MESSAGES = ("server has gone away", "lost connection", "connection refused", "connection is closed")


def connection_lost(code: str | None, message: str) -> bool:
    return str(code) in LOST_CODES or any(x in message.lower() for x in LOST_MESSAGES)


def with_reconnect(action: Callable[[], object], reconnect: Callable[[], None] | None = None) -> object:
    """What ``action`` gives; where it fails for a lost connection and there is a
    way to ``reconnect``, that is taken once and ``action`` tried once more."""
    try:
        return action()
    except Exception as error:
        if reconnect is None or not connection_lost(getattr(error, "code", None), str(error)):
            raise
        reconnect()
        return action()


@dataclass(frozen=True)
class WorkerOptions:
    poll_timeout: int = 5
    stuck_job_ttl: int = 600
    retry_base_delay: int = 2
    retry_max_delay: int = 300
    max_jobs: int = 0
    max_time: int = 0
    memory_limit: int = 0
    stop_when_empty: bool = False
    promote_interval: float = 5.0
    promote_limit: int = 100
    recovery_interval: float = 60.0

    def __post_init__(self):
        if self.poll_timeout < 0 or self.stuck_job_ttl < 1 or self.retry_base_delay < 0 or self.promote_limit < 1:
            raise ValueError("poll_timeout and retry_base_delay must not be negative, stuck_job_ttl and promote_limit must be positive")
        if self.retry_max_delay < self.retry_base_delay:
            raise ValueError("retry_max_delay must not be less than retry_base_delay")
        if min(self.max_jobs, self.max_time, self.memory_limit, self.promote_interval, self.recovery_interval) < 0:
            raise ValueError("limits and intervals must not be negative")

    @classmethod
    def parse(cls, raw: dict) -> WorkerOptions:
        """Numbers may be given as text; what is no number means the default."""

        def number(value, default):
            try:
                return type(default)(value)
            except (TypeError, ValueError):
                return default

        return cls(**{f.name: (bool(raw[f.name]) if isinstance(f.default, bool) else number(raw[f.name], f.default)) for f in fields(cls) if f.name in raw})


@dataclass(frozen=True)
class ReconcileOptions:
    page_size: int = 100
    membership_limit: int = 250
    time_limit: float = 1.0

    def __post_init__(self):
        if self.page_size < 1 or self.membership_limit < 1 or self.time_limit <= 0:
            raise ValueError("page_size, membership_limit and time_limit must be positive")


def check_timeout(poll_timeout: int, read_timeout: float | None) -> None:
    if read_timeout is not None and read_timeout > 0 and poll_timeout >= read_timeout:
        raise ValueError("poll_timeout must be less than the client's read timeout")


def check_dispatch(kind: str, queue: str, max_attempts: int, request_id: str | None = None) -> None:
    for name, value in (("type", kind), ("queue", queue), *([("request_id", request_id)] if request_id is not None else [])):
        if not value.strip():
            raise ValueError(f"{name} must not be blank")
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
