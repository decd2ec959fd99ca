"""Filters, counts, keyset pages and listings of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import can_retry, is_active, is_terminal
from ..schema import FAILED, JOB_COLUMNS, PENDING


def find(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.where(F.col("id") == job_id)


def find_active_by_request(jobs: DataFrame, request_id: str) -> DataFrame:
    return jobs.where((F.col("request_id") == request_id) & is_active(F.col("status"))).orderBy("id").limit(1)


def job_filter(status: str | None = None, queue: str | None = None) -> Column:
    """Both conditions, each left out where it is None."""
    keep = F.lit(True)
    if status is not None:
        keep = keep & (F.col("status") == status)
    if queue is not None:
        keep = keep & (F.col("queue") == queue)
    return keep


def list_jobs(jobs: DataFrame, status: str | None = None, queue: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return jobs.where(job_filter(status, queue)).orderBy(F.desc("id")).offset(offset).limit(limit)


def count_jobs(jobs: DataFrame, status: str | None = None, queue: str | None = None) -> DataFrame:
    return jobs.where(job_filter(status, queue)).agg(F.count("*").alias("n"))


def count_by(jobs: DataFrame, *columns: str) -> DataFrame:
    return jobs.groupBy(*columns).agg(F.count("*").alias("n"))


def scan_pending(jobs: DataFrame, queue: str, after_id: int | None, limit: int) -> DataFrame:
    """The next page of pending jobs by id, due or not."""
    if limit < 1:
        raise ValueError("limit must be positive")
    page = jobs.where(job_filter(PENDING, queue))
    return (page if after_id is None else page.where(F.col("id") > after_id)).orderBy("id").limit(limit)


def list_failed(jobs: DataFrame, queue: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return list_jobs(jobs, FAILED, queue, limit, offset)


def inspect_failed(jobs: DataFrame, job_id: int) -> DataFrame:
    return find(jobs, job_id).where(F.col("status") == FAILED)


def with_predicates(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({"is_finished": is_terminal(F.col("status")), "can_retry": can_retry(F.col("attempts"), F.col("max_attempts"))})


def everything(jobs: DataFrame) -> DataFrame:
    """The whole ledger in its fixed order of columns."""
    return jobs.select(*JOB_COLUMNS)


def cleared(jobs: DataFrame) -> DataFrame:
    """An empty ledger, in which ids begin at 1 again."""
    return jobs.limit(0)
