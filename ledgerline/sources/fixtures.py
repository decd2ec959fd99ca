"""Ledger views derived from the star-schema tables, in both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "1998-07-01 00:00:00"

_JOBS = """SELECT o_orderkey + 1 AS id, o_orderpriority AS queue,
  CASE o_custkey % 3 WHEN 0 THEN 'mail.send' WHEN 1 THEN 'invoice.generate' ELSE 'report.build' END AS type,
  CASE WHEN o_orderstatus = 'P' THEN (CASE WHEN o_orderkey % 7 = 0 THEN 'cancelled' ELSE 'pending' END)
       WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CONCAT('{"customer":', CAST(o_custkey AS VARCHAR(20)), ',"order":', CAST(o_orderkey AS VARCHAR(20)), '}') AS payload,
  CAST(o_orderkey % 3 AS INT) AS attempts, CAST(3 AS INT) AS max_attempts, o_orderdate AS available_at,
  CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderdate END AS started_at,
  CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 7 = 0) THEN o_orderdate + INTERVAL '1' DAY END AS completed_at,
  CASE WHEN o_orderstatus = 'O' THEN CONCAT('worker-', CAST(o_custkey % 8 AS VARCHAR(20))) END AS locked_by,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 11 <> 0 THEN :time '1998-07-01 00:00:00' - :seconds(o_orderkey % 1200) END AS locked_at,
  CASE WHEN o_orderstatus = 'O' THEN :sha(CONCAT(CAST(o_orderkey AS VARCHAR(20)), '-', CAST(o_custkey AS VARCHAR(20)))) END AS lease_token,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'handler failed' END AS error_message,
  CAST(NULL AS VARCHAR(20)) AS error_trace,
  CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 101 AS INT) END AS progress,
  CAST(NULL AS VARCHAR(20)) AS progress_message,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 0 THEN '{"ok":true}' END AS result,
  CASE WHEN o_orderkey % 5 <> 0 THEN CONCAT('req-', CAST(o_custkey AS VARCHAR(20))) END AS request_id,
  o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders"""
_NOTIFICATIONS = """SELECT queue, id AS job_id, 'pending' AS list, id AS seq, CAST(NULL AS :time) AS score
FROM jobs WHERE status = 'pending' AND available_at <= :time '1998-07-01 00:00:00' AND id % 3 <> 0
UNION ALL
SELECT queue, id, 'delayed', id, available_at FROM jobs WHERE status = 'pending' AND available_at > :time '1998-07-01 00:00:00' AND id % 4 <> 0
UNION ALL
SELECT queue, id, 'processing', id, locked_at FROM jobs WHERE status = 'running'"""
_TRANSITIONS = """SELECT id, CASE WHEN (id - id % 5) % 10 = 0 THEN COALESCE(lease_token, 'none') ELSE 'stale' END AS lease_token,
  CASE id % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'retry' WHEN 3 THEN 'progress' ELSE 'heartbeat' END AS kind
FROM jobs"""
_REQUESTS = """SELECT o_orderkey AS seq, 'mail.send' AS type, o_orderpriority AS queue,
  CONCAT('req-', CAST(o_custkey + (o_orderkey % 2) * 100000 AS VARCHAR(20))) AS request_id
FROM orders WHERE o_orderkey % 6 = 0"""
_EVENTS = """SELECT event_id, ts, user_id + 1 AS job_id,
  CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'retried'
       WHEN 'error' THEN 'failed' ELSE 'backoff' END AS event, value AS duration_ms
FROM events"""
_LOG = """SELECT event_id AS seq, ts, user_id AS job_id,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete'
       WHEN 'error' THEN 'fail' ELSE 'heartbeat' END AS op
FROM events"""

#: View: its query and the tables that it reads.
VIEWS = {
    "jobs": (_JOBS, ("orders",)),
    "notifications": (_NOTIFICATIONS, ("jobs",)),
    "transitions": (_TRANSITIONS, ("jobs",)),
    "create_requests": (_REQUESTS, ("orders",)),
    "worker_events": (_EVENTS, ("events",)),
    "op_log": (_LOG, ("events",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    query, inputs = VIEWS[name]
    query = query.replace(":time", "TIMESTAMP_NTZ").replace(":seconds(o_orderkey % 1200)", "make_dt_interval(0, 0, 0, o_orderkey % 1200)")
    query = query.replace(":sha(", "sha2(").replace("AS VARCHAR(20)))) END AS lease", "AS VARCHAR(20))), 256) END AS lease")
    query = query.replace("{", "{{").replace("}", "}}")
    for table in inputs:
        query = query.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(query, **{table: view(spark, sf_dir, table) for table in inputs})


def oracle_views(*names: str) -> str:
    """``WITH`` clause of the views, and those that they read, for DuckDB."""
    wanted: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in wanted:
            query, inputs = VIEWS[name]
            for table in inputs:
                add(table)
            wanted[name] = query.replace(":time", "TIMESTAMP").replace(":seconds(", "to_seconds(").replace(":sha(", "sha256(")

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in wanted.items())
