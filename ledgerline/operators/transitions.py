"""Fenced and plain state transitions, all of a batch in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import after, before, delay, short_trace
from ..schema import CANCELLED, COMPLETED, FAILED, PENDING, RUNNING

_RELEASE = ("locked_by", "locked_at", "lease_token")
_EXTRA = {"result": "string", "error": "string", "trace": "string", "attempts": "int", "delay": "int", "progress": "int", "message": "string"}


#: Which of a job's requests goes first: what settles it, then progress, then a heartbeat.
_ORDER = {"complete": 0, "fail": 0, "retry": 0, "progress": 1, "heartbeat": 2}


def one_request(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Of the ``requests(id, lease_token, kind, seq, ...)`` for a job the one that
    counts: with the right token before a wrong one, what settles the job before
    progress and heartbeats, and of several the first by ``seq`` (of progress
    the last).  Without ``seq`` those of one kind are taken in order of their values.
    """
    names = [c for c in requests.columns if c != "id"]
    held = jobs.select("id", F.col("lease_token").alias("_held"))
    met = requests.join(held, "id", "left")
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in _ORDER.items() for x in kv))[F.col("kind")], F.lit(9)) if "kind" in names else F.lit(0)
    seq = F.col("seq").cast("long") if "seq" in names else F.lit(0)
    last_first = F.when(F.lit("kind" in names) & (rank == 1), -seq).otherwise(seq)
    best = F.min(F.struct((~F.coalesce(F.col("lease_token") == F.col("_held"), F.lit(False))).alias("_wrong"), rank.alias("_rank"), last_first.alias("_at"), *names)).alias("_best")
    return met.groupBy("id").agg(best).select("id", *(F.col(f"_best.{c}").alias(c) for c in names))


def fenced(jobs: DataFrame, requests: DataFrame, touched: bool = False) -> DataFrame:
    """``jobs`` with the columns of ``requests(id, lease_token, ...)`` under names
    with ``r_``, and ``owned``: whether the job runs under that token.

    A job meets one request, chosen by :func:`one_request`.  ``touched``: only
    the jobs with a request, so that the rest of the ledger need not move.
    """
    have = set(requests.columns)
    asked = one_request(jobs, requests)
    extra = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(f"r_{c}") for c, kind in _EXTRA.items()]
    kind = F.col("kind").alias("r_kind") if "kind" in have else F.lit("heartbeat").alias("r_kind")
    asked = asked.select("id", F.col("lease_token").alias("r_token"), kind, *extra)
    owned = (F.col("status") == RUNNING) & (F.col("lease_token") == F.col("r_token"))
    return jobs.join(asked, "id", "inner" if touched else "left").withColumn("owned", F.coalesce(owned, F.lit(False)))


def _changed(rows: DataFrame, columns: list[str], cases: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Each column's new value in the first case that holds."""
    out = []
    for name in columns:
        value = None
        for when, new in cases:
            chosen = new.get(name, F.col(name))
            value = F.when(when, chosen) if value is None else value.when(when, chosen)
        out.append(value.otherwise(F.col(name)).alias(name) if any(name in new for _, new in cases) else F.col(name))
    return rows.select(*out, *(c for c in rows.columns if c not in columns))


def settle(jobs: DataFrame, requests: DataFrame, now: Column, base: int = 2, cap: int = 300, touched: bool = False) -> DataFrame:
    """The ledger after complete, fail, retry, progress and heartbeat requests,
    with ``affected``: 1 where a request's fence held.

    A retry without attempts or delay takes one attempt more and the delay of
    the backoff policy.  What a request says of progress is kept whichever its
    kind.  A request whose token is not the job's changes nothing; of several for
    a job one counts (:func:`one_request`).  ``touched``: the jobs with a request
    alone, as changes to commit.
    """
    rows = fenced(jobs, requests, touched)
    bad = F.col("r_progress").isNotNull() & ~F.col("r_progress").between(0, 100)
    rows = rows.withColumn("r_progress", F.when(bad, F.raise_error(F.lit("progress must be from 0 to 100")).cast("int")).otherwise(F.col("r_progress")))
    wrong = (F.col("r_kind") == "retry") & ((F.col("r_attempts") < 1) | (F.col("r_delay") < 0))
    rows = rows.withColumn("r_attempts", F.when(wrong, F.raise_error(F.lit("attempts must be at least 1 and delay not negative")).cast("int")).otherwise(F.coalesce("r_attempts", F.col("attempts") + 1)))
    wait = F.coalesce(F.col("r_delay"), delay(base, F.col("r_attempts"), cap))
    free = {c: F.lit(None) for c in _RELEASE} | {"updated_at": now}
    beat = {"locked_at": now, "updated_at": now}
    free |= {"progress": F.coalesce("r_progress", "progress"), "progress_message": F.when(F.col("r_progress").isNull(), F.col("progress_message")).otherwise(F.col("r_message"))}
    cases = {
        "complete": {"status": F.lit(COMPLETED), "result": F.col("r_result"), "completed_at": now, **free},
        "fail": {"status": F.lit(FAILED), "error_message": F.col("r_error"), "error_trace": short_trace(F.col("r_trace")), "completed_at": now, **free},
        "retry": {"status": F.lit(PENDING), "attempts": F.col("r_attempts"), "available_at": after(now, wait), "error_message": F.col("r_error"), **free},
        "progress": {"progress": F.col("r_progress"), "progress_message": F.col("r_message"), **beat},
        "heartbeat": beat,
    }
    made = _changed(rows, jobs.columns, [(F.col("owned") & (F.col("r_kind") == kind), new) for kind, new in cases.items()])
    return made.select(*jobs.columns, F.col("owned").cast("int").alias("affected"))


def _plain(jobs: DataFrame, ids: DataFrame, when: Column, new: dict[str, Column]) -> DataFrame:
    rows = jobs.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("_asked") & when, F.lit(False))
    made = _changed(rows.withColumn("_hit", hit), jobs.columns, [(F.col("_hit"), new)])
    return made.select(*jobs.columns, F.col("_hit").cast("int").alias("affected"))


def cancel(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Only pending jobs can be cancelled."""
    return _plain(jobs, ids, F.col("status") == PENDING, {"status": F.lit(CANCELLED), "completed_at": now, "updated_at": now, **{c: F.lit(None) for c in _RELEASE}})


def requeue_failed(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    gone = ("started_at", "completed_at", "error_message", "error_trace", "progress", "progress_message", "result", *_RELEASE)
    return _plain(jobs, ids, F.col("status") == FAILED, {"status": F.lit(PENDING), "attempts": F.lit(0), "available_at": now, "updated_at": now, **{c: F.lit(None) for c in gone}})


def purge_failed(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger without those of ``ids`` that have failed."""
    return jobs.join(jobs.where(F.col("status") == FAILED).select("id").join(ids.select("id"), "id", "left_semi"), "id", "left_anti")


def prune_completed(jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The ledger without jobs completed or cancelled over ``days`` days ago."""
    old = F.col("status").isin(COMPLETED, CANCELLED) & (F.col("completed_at") < before(now, days * 86400))
    return jobs.where(~F.coalesce(old, F.lit(False)))
