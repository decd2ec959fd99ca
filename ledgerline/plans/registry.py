"""The registered queries of the ledger operators, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import claims, dispatch, events, ingest, notify, reads, reconcile, recovery, runner, tooling, transitions, worker
from ..sources import ledger
from ..sources.fixtures import NOW, oracle_views, view
from ..sources.shared import shared_folder
from ..streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: The queue, job and request that point queries look for.
QUEUE, JOB, REQUEST, T = "1-URGENT", 42, "req-7", f"TIMESTAMP '{NOW}'"


def _now() -> Column:
    return rules.moment(NOW)


def _query(views: str, sql: str | None):
    """Registers a function of the named views, and its SQL over them."""
    names = views.split()

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))
        if sql is not None:
            _ORACLES[f.__name__] = f"{oracle_views(*names)}\n{sql}" if any(n in oracle_views(n) for n in names if n not in ("documents", "events", "orders")) else sql
        return f

    return add


# -- reads -------------------------------------------------------------------

_ROW = "id, queue, type, status, payload, attempts, max_attempts, available_at, started_at, completed_at, locked_by, locked_at, lease_token, error_message, error_trace, progress, progress_message, result, request_id, created_at, updated_at"


@_query("jobs", f"SELECT {_ROW} FROM jobs WHERE id = {JOB}")
def find_job(jobs):
    return ledger.export(reads.find(jobs, JOB))


@_query("jobs", f"SELECT {_ROW} FROM jobs WHERE request_id = '{REQUEST}' AND status IN ('pending', 'running') ORDER BY id LIMIT 1")
def find_active_by_request(jobs):
    return reads.find_active_by_request(jobs, REQUEST)


@_query("jobs", f"SELECT {_ROW} FROM jobs WHERE status = 'pending' AND queue = '{QUEUE}' ORDER BY id DESC LIMIT 50 OFFSET 10")
def list_jobs_page(jobs):
    return reads.list_jobs(jobs, "pending", QUEUE, 50, 10)


@_query("jobs", f"SELECT {_ROW} FROM jobs WHERE status = 'failed' ORDER BY id DESC LIMIT 100")
def list_failed_page(jobs):
    return reads.list_failed(jobs)


@_query("jobs", f"SELECT {_ROW} FROM jobs WHERE status = 'failed' AND id = 25")
def inspect_failed(jobs):
    return reads.inspect_failed(jobs, 25)


@_query("jobs", "SELECT status, queue, count(*) AS n FROM jobs GROUP BY ALL")
def count_by_status_queue(jobs):
    return reads.count_by(jobs, "status", "queue")


@_query("jobs", "SELECT count(*) AS n FROM jobs WHERE status = 'running'")
def count_running(jobs):
    return reads.count_jobs(jobs, "running")


@_query("jobs", f"SELECT {_ROW} FROM jobs WHERE status = 'pending' AND queue = '{QUEUE}' AND id > 1000 ORDER BY id LIMIT 100")
def scan_pending_keyset(jobs):
    return reads.scan_pending(jobs, QUEUE, 1000, 100)


@_query("jobs", "SELECT id, status IN ('completed', 'failed', 'cancelled') AS is_finished, attempts < max_attempts AS can_retry FROM jobs")
def job_predicates(jobs):
    return reads.with_predicates(jobs).select("id", "is_finished", "can_retry")


@_query(
    "jobs",
    """ SELECT id, CASE WHEN id % 7 = 1 THEN 'default' ELSE queue END AS queue, CASE WHEN id % 7 = 2 THEN 3 ELSE max_attempts END AS max_attempts,
CASE id % 7 WHEN 3 THEN 'unknown status' WHEN 4 THEN 'payload is no JSON object' WHEN 5 THEN 'result is no JSON' END AS error FROM jobs""",
)
def hydrate_rows(jobs):
    odd = lambda c, k, value: F.when(F.col("id") % 7 == k, F.lit(value)).otherwise(F.col(c).cast("string"))
    raw = jobs.withColumns({"queue": odd("queue", 1, None), "max_attempts": odd("max_attempts", 2, None), "status": odd("status", 3, "gone"), "payload": odd("payload", 4, "[1]"), "result": odd("result", 5, "{x")})
    return ledger.hydrate(raw).select("id", "queue", "max_attempts", F.col("_error").alias("error"))


# -- ingest ------------------------------------------------------------------


@_query("jobs create_requests", f"SELECT (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY seq) AS id, queue, type, request_id, 'pending' AS status, CAST(0 AS INT) AS attempts, CAST(3 AS INT) AS max_attempts, {T} AS available_at FROM create_requests")
def create_jobs_batch(jobs, create_requests):
    return ingest.create_jobs(jobs, create_requests, _now()).select("id", "queue", "type", "request_id", "status", "attempts", "max_attempts", "available_at")


@_query("jobs", f"SELECT id, CASE WHEN available_at > {T} THEN 'delayed' ELSE 'pending' END AS list, CASE WHEN available_at > {T} THEN available_at ELSE {T} END AS due FROM jobs WHERE status = 'pending'")
def dispatch_scheduled_split(jobs):
    due = ingest.available_at(F.col("available_at"), _now())
    return jobs.where("status = 'pending'").select("id", ingest.dispatch_list(F.col("available_at"), _now()).alias("list"), due.alias("due"))


@_query("jobs", f"SELECT id, {T} + to_seconds(id % 900) AS due FROM jobs")
def dispatch_after_delay(jobs):
    return jobs.select("id", ingest.dispatch_after(_now(), F.col("id") % 900).alias("due"))


@_query(
    "jobs create_requests",
    """, active AS (SELECT request_id, min(id) AS active_id FROM jobs WHERE status IN ('pending', 'running') AND request_id IS NOT NULL GROUP BY 1),
met AS (SELECT r.*, active_id FROM create_requests r LEFT JOIN active USING (request_id)),
makers AS (SELECT request_id, min(seq) AS maker FROM met WHERE active_id IS NULL GROUP BY 1),
fresh AS (SELECT *, (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY maker) AS new_id FROM makers)
SELECT m.seq, m.request_id, coalesce(active_id, new_id) AS job_id, active_id IS NULL AND m.seq = maker AS created FROM met m LEFT JOIN fresh USING (request_id)""",
)
def dispatch_idempotent(jobs, create_requests):
    return ingest.idempotent(jobs, create_requests).select("seq", "request_id", "job_id", F.coalesce("created", F.lit(False)).alias("created"))


# -- claims ------------------------------------------------------------------

_CLAIM = f""", ranked AS (SELECT id, queue, row_number() OVER (PARTITION BY queue ORDER BY available_at, id) AS rank FROM jobs WHERE status = 'pending' AND available_at <= {T}),
claimed AS (SELECT id, queue, rank, 'worker-' || CAST((rank - 1) % 4 AS VARCHAR) AS worker_id FROM ranked WHERE rank <= 100)"""


@_query("jobs", _CLAIM + " SELECT id, queue, CAST(rank AS INT) AS rank, worker_id FROM claimed")
def claim_next_topk(jobs):
    return claims.claim_next(jobs, _now(), 100, 4).drop("lease_token")


@_query("jobs", _CLAIM + " SELECT queue, worker_id, count(*) AS n FROM claimed GROUP BY ALL")
def claim_worker_distribution(jobs):
    return reads.count_by(claims.claim_next(jobs, _now(), 100, 4), "queue", "worker_id")


@_query("jobs", _CLAIM + " SELECT id, sha256(concat_ws('|', CAST(id AS VARCHAR), worker_id, '1')) AS lease_token FROM claimed")
def lease_token_sha(jobs):
    return claims.claim_next(jobs, _now(), 100, 4).select("id", "lease_token")


@_query("jobs", _CLAIM + f" SELECT j.id, CASE WHEN c.id IS NULL THEN status ELSE 'running' END AS status, attempts, CASE WHEN c.id IS NULL THEN locked_by ELSE worker_id END AS locked_by, CASE WHEN c.id IS NULL THEN locked_at ELSE {T} END AS locked_at FROM jobs j LEFT JOIN claimed c ON j.id = c.id")
def claim_after_state(jobs):
    return claims.apply_claims(jobs, claims.claim_next(jobs, _now(), 100, 4), _now()).select("id", "status", "attempts", "locked_by", "locked_at")


@_query("jobs", f"SELECT id, queue, 'worker-3' AS worker_id, sha256(concat_ws('|', CAST(id AS VARCHAR), 'worker-3', '2')) AS lease_token FROM jobs WHERE ((status = 'pending' AND available_at <= {T}) OR (status = 'running' AND locked_by = 'worker-3'))")
def claim_by_id(jobs):
    asked = jobs.select("id", F.lit("worker-3").alias("worker_id"))
    return claims.claim_by_id(jobs, asked, _now(), 2)


# -- transitions -------------------------------------------------------------

_OWNED = ", f AS (SELECT j.*, t.kind, t.lease_token AS token, coalesce(j.status = 'running' AND j.lease_token = t.lease_token, false) AS owned FROM jobs j LEFT JOIN transitions t USING (id))"


@_query("jobs transitions", _OWNED + " SELECT id, kind, owned, CASE WHEN owned THEN 'owned' ELSE 'lost' END AS outcome FROM f WHERE kind IS NOT NULL")
def fence_check(jobs, requests):
    rows = transitions.fenced(jobs, requests).where("r_kind IS NOT NULL AND r_token IS NOT NULL")
    return rows.select("id", F.col("r_kind").alias("kind"), "owned", rules.ownership(F.col("owned")).alias("outcome"))


@_query(
    "jobs transitions",
    _OWNED
    + f""" SELECT id, CASE WHEN owned AND kind = 'complete' THEN 'completed' WHEN owned AND kind = 'fail' THEN 'failed' WHEN owned AND kind = 'retry' THEN 'pending' ELSE status END AS status,
CASE WHEN owned AND kind = 'retry' THEN attempts + 1 ELSE attempts END AS attempts,
CASE WHEN owned AND kind = 'retry' THEN {T} + to_seconds(CAST(least(pow(2, attempts + 1), 300) AS INT)) ELSE available_at END AS available_at,
CASE WHEN owned AND kind IN ('complete', 'fail', 'retry') THEN NULL ELSE lease_token END AS lease_token,
CASE WHEN owned AND kind IN ('progress', 'heartbeat') THEN {T} WHEN owned THEN NULL ELSE locked_at END AS locked_at,
CASE WHEN owned AND kind IN ('complete', 'fail') THEN {T} ELSE completed_at END AS completed_at,
CASE WHEN owned THEN {T} ELSE updated_at END AS updated_at, CAST(owned AS INT) AS affected FROM f""",
)
def settle_after_state(jobs, requests):
    return transitions.settle(jobs, requests, _now()).select("id", "status", "attempts", "available_at", "lease_token", "locked_at", "completed_at", "updated_at", "affected")


def _one_kind(kind: str, columns: list[str], extra: Callable[[], dict[str, Column]]):
    def run(jobs, requests):
        asked = requests.where(F.col("kind") == kind).withColumns(extra())
        return transitions.settle(jobs, asked, _now()).where("affected = 1").select("id", *columns)

    return run


def _kinds() -> None:
    base = _OWNED + " SELECT id, {} FROM f WHERE owned AND kind = '{}'"
    for name, kind, columns, extra, sql in (
        ("mark_completed", "complete", ["status", "result", "completed_at", "locked_by"], lambda: {"result": F.lit('{"ok":1}')}, f"'completed' AS status, '{{\"ok\":1}}' AS result, {T} AS completed_at, CAST(NULL AS VARCHAR) AS locked_by"),
        ("mark_failed", "fail", ["status", "error_message", "error_trace", "attempts"], lambda: {"error": F.lit("boom"), "trace": F.repeat(F.lit("x"), 4001)}, "'failed' AS status, 'boom' AS error_message, repeat('x', 4000) || chr(10) || '... [truncated]' AS error_trace, attempts"),
        ("update_progress", "progress", ["progress", "progress_message", "locked_at"], lambda: {"progress": F.lit(55), "message": F.lit("half")}, f"CAST(55 AS INT) AS progress, 'half' AS progress_message, {T} AS locked_at"),
        ("heartbeat", "heartbeat", ["locked_at", "updated_at", "status"], dict, f"{T} AS locked_at, {T} AS updated_at, status"),
        ("schedule_retry", "retry", ["status", "attempts", "available_at", "error_message"], lambda: {"attempts": F.lit(2), "delay": F.lit(60), "error": F.lit("again")}, f"'pending' AS status, CAST(2 AS INT) AS attempts, {T} + to_seconds(60) AS available_at, 'again' AS error_message"),
    ):
        f = lambda j, t, kind=kind, columns=columns, extra=extra: _one_kind(kind, columns, extra)(j, t)
        f.__name__ = name
        _query("jobs transitions", base.replace("{}", sql, 1).replace("{}", kind, 1))(f)


@_query("jobs", f"SELECT id, CASE WHEN status = 'pending' AND id % 2 = 0 THEN 'cancelled' ELSE status END AS status, CASE WHEN status = 'pending' AND id % 2 = 0 THEN {T} ELSE completed_at END AS completed_at, CAST(status = 'pending' AND id % 2 = 0 AS INT) AS affected FROM jobs")
def cancel_pending(jobs):
    return transitions.cancel(jobs, jobs.where("id % 2 = 0").select("id"), _now()).select("id", "status", "completed_at", "affected")


@_query("jobs", f"SELECT id, 'pending' AS status, CAST(0 AS INT) AS attempts, {T} AS available_at, CAST(NULL AS VARCHAR) AS error_message FROM jobs WHERE status = 'failed'")
def requeue_failed(jobs):
    return transitions.requeue_failed(jobs, jobs.select("id"), _now()).where("affected = 1").select("id", "status", "attempts", "available_at", "error_message")


@_query("jobs", "SELECT id, status FROM jobs WHERE NOT (status = 'failed' AND id % 2 = 1)")
def purge_failed(jobs):
    return transitions.purge_failed(jobs, jobs.where("id % 2 = 1").select("id")).select("id", "status")


@_query("jobs", f"SELECT id, status FROM jobs WHERE NOT coalesce(status IN ('completed', 'cancelled') AND completed_at < {T} - to_seconds(7 * 86400), false)")
def prune_completed(jobs):
    return transitions.prune_completed(jobs, _now()).select("id", "status")


# -- recovery ----------------------------------------------------------------


@_query(
    "jobs",
    f""", s AS (SELECT *, coalesce(status = 'running' AND locked_at < {T} - to_seconds(600), false) AS stale FROM jobs)
SELECT id, CASE WHEN stale AND attempts + 1 >= max_attempts THEN 'failed' WHEN stale THEN 'pending' ELSE status END AS status,
CASE WHEN stale AND attempts + 1 < max_attempts THEN attempts + 1 ELSE attempts END AS attempts,
CASE WHEN stale AND attempts + 1 >= max_attempts THEN 'Job timed out / worker crashed (stale recovery)' ELSE error_message END AS error_message,
CASE WHEN stale AND attempts + 1 < max_attempts THEN {T} ELSE available_at END AS available_at, CAST(stale AS INT) AS affected FROM s""",
)
def recover_stale_all(jobs):
    return recovery.recover_stale(jobs, 600, _now()).select("id", "status", "attempts", "error_message", "available_at", "affected")


@_query(
    "jobs",
    f""", s AS (SELECT id FROM jobs WHERE status = 'running' AND queue = '{QUEUE}' AND locked_at < {T} - to_seconds(600) ORDER BY locked_at, id LIMIT 100)
SELECT id, CASE WHEN attempts + 1 >= max_attempts THEN 'failed' ELSE 'pending' END AS status, attempts + 1 AS attempts, error_message, {T} AS available_at FROM jobs WHERE id IN (SELECT id FROM s)""",
)
def recover_stale_scoped(jobs):
    return recovery.recover_stale_in_queue(jobs, QUEUE, 600, 100, _now()).where("affected = 1").select("id", "status", "attempts", "error_message", "available_at")


def _moved_sql(which: str, limit: int) -> str:
    return f""", r AS (SELECT queue, job_id, row_number() OVER (PARTITION BY queue ORDER BY score, CAST(job_id AS VARCHAR)) AS r FROM notifications WHERE {which})
SELECT queue, job_id, (SELECT max(seq) FROM notifications) + r AS seq FROM r WHERE r <= {limit}"""


@_query("notifications", _moved_sql(f"list = 'processing' AND score <= {T} - to_seconds(600)", 100))
def recover_stale_processing(notifications):
    return recovery.recover_stale_processing(notifications, 600, _now()).where("moved").select("queue", "job_id", "seq")


@_query("notifications", f", r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY job_id) AS r FROM notifications WHERE list = 'processing') SELECT queue, job_id, {T} AS score FROM r WHERE r <= 500 AND score IS NULL")
def repair_unscored(notifications):
    return recovery.repair_unscored(notifications, _now(), 500).where("repaired").select("queue", "job_id", "score")


@_query("jobs", "SELECT id, CAST(least(pow(2, id % 1200), 300) AS INT) AS wait, CASE WHEN attempts + 1 < max_attempts THEN 'retry' ELSE 'fail' END AS decision FROM jobs")
def retry_policy(jobs):
    return jobs.select("id", rules.delay(2, F.col("id") % 1200, 300).alias("wait"), rules.retry_decision(F.col("attempts"), F.col("max_attempts")).alias("decision"))


# -- notifications -----------------------------------------------------------


@_query("notifications", ", r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq, job_id) AS r FROM notifications WHERE list = 'pending') SELECT queue, job_id, 'processing' AS list, " + T + " AS score FROM r WHERE r <= 50")
def fifo_dequeue(notifications):
    return notify.dequeue(notifications, 50, _now()).where("moved").select("queue", "job_id", "list", "score")


@_query("notifications", _moved_sql("list = 'delayed' AND score <= TIMESTAMP '1999-01-01 00:00:00'", 100))
def promote_delayed(notifications):
    return notify.promote_delayed(notifications, rules.moment("1999-01-01 00:00:00"), 100).where("moved").select("queue", "job_id", "seq")


@_query("notifications", f"SELECT queue, job_id, CASE WHEN job_id % 3 > 0 THEN 'delayed' ELSE 'pending' END AS list, CASE WHEN job_id % 3 > 0 THEN {T} + to_seconds(job_id % 3) END AS score, (SELECT max(seq) FROM notifications) + row_number() OVER (PARTITION BY queue ORDER BY job_id) AS seq FROM notifications WHERE list = 'processing'")
def nack_route(notifications):
    asked = notifications.where("list = 'processing'").select("queue", "job_id", (F.col("job_id") % 3).cast("int").alias("delay"))
    return notify.nack(notifications, asked.unionAll(asked), _now()).where("moved").select("queue", "job_id", "list", "score", "seq")


@_query("notifications", "SELECT queue, count(*) FILTER (list = 'pending') AS pending, count(*) FILTER (list = 'processing') AS processing, count(*) FILTER (list = 'delayed') AS delayed FROM notifications GROUP BY 1")
def queue_stats(notifications):
    return notify.stats(notifications)


@_query("notifications", ", r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq DESC, job_id DESC) AS r FROM notifications WHERE list = 'pending') SELECT DISTINCT queue, job_id FROM r WHERE r <= 250")
def pending_membership_bounded(notifications):
    return notify.newest_pending(notifications, 250)


@_query("notifications", "SELECT queue, job_id, list FROM notifications WHERE NOT (list = 'processing' AND job_id % 2 = 0)")
def ack_processing(notifications):
    return notify.ack(notifications, notifications.where("job_id % 2 = 0").select("queue", "job_id")).select("queue", "job_id", "list")


@_query("jobs notifications", "SELECT queue, job_id, list FROM notifications n WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = n.job_id AND j.status = 'running')")
def remove_notifications(jobs, notifications):
    return notify.remove(notifications, jobs.where("status = 'running'").select("queue", F.col("id").alias("job_id"))).select("queue", "job_id", "list")


@_query("notifications", f"SELECT job_id, seq FROM notifications WHERE queue = '{QUEUE}' AND list = 'pending'")
def list_pending_ids(notifications):
    return notify.listing(notifications, QUEUE, "pending")


@_query("notifications", f"SELECT queue, job_id, CASE WHEN list = 'processing' AND job_id % 2 = 0 THEN {T} ELSE score END AS score FROM notifications")
def heartbeat_processing(notifications):
    return notify.heartbeat(notifications, notifications.where("job_id % 2 = 0").select("queue", "job_id"), _now()).select("queue", "job_id", "score")


@_query("jobs notifications", f"SELECT queue, list, count(*) AS n, count(DISTINCT job_id) AS ids FROM (SELECT queue, job_id, list FROM notifications UNION ALL SELECT queue, id, 'pending' FROM jobs WHERE status = 'failed') GROUP BY ALL")
def enqueue_batch(jobs, notifications):
    made = notify.enqueue(notifications, jobs.where("status = 'failed'").select("queue", F.col("id").alias("job_id"), F.col("id").alias("seq")))
    return made.groupBy("queue", "list").agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("ids"))


@_query("jobs notifications", f", n AS (SELECT queue, id AS job_id, {T} + to_seconds(id % 60) AS score FROM jobs WHERE status = 'pending' AND id % 4 < 2) SELECT queue, job_id, list, score FROM notifications x WHERE NOT (list = 'delayed' AND EXISTS (SELECT 1 FROM n WHERE n.queue = x.queue AND n.job_id = x.job_id)) UNION ALL SELECT queue, job_id, 'delayed', score FROM n")
def enqueue_delayed_batch(jobs, notifications):
    new = jobs.where("status = 'pending' AND id % 4 < 2").select("queue", F.col("id").alias("job_id"), F.col("id").alias("seq"), rules.after(_now(), F.col("id") % 60).alias("score"))
    return notify.enqueue_delayed(notifications, new).select("queue", "job_id", "list", "score")


@_query("jobs", f"SELECT queue, id AS job_id, CASE WHEN available_at <= {T} THEN 'pending' ELSE 'delayed' END AS list FROM jobs WHERE status = 'pending'")
def derived_notifications(jobs):
    return notify.derived(jobs, _now()).select("queue", "job_id", "list")


# -- dispatch and administration ----------------------------------------------

@_query(
    "jobs notifications",
    f""", o AS (SELECT id, payload, (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY id) AS new_id FROM jobs WHERE status = 'failed')
SELECT new_id AS id, 'audit' AS queue, 'job.audit' AS type, payload, CAST(5 AS INT) AS max_attempts, CAST(NULL AS VARCHAR) AS request_id, {T} + to_seconds(90) AS available_at,
'delayed' AS list, (SELECT max(seq) FROM notifications) + row_number() OVER (ORDER BY new_id) AS seq, {T} + to_seconds(90) AS score FROM o""",
)
def dispatch_batch(jobs, notifications):
    payloads = jobs.where("status = 'failed'").select(F.col("id").alias("seq"), "payload")
    made = dispatch.dispatch_batch(jobs, notifications, payloads, "job.audit", _now(), "audit", 5, rules.after(_now(), 90))
    rows = made.jobs.select("id", "type", "payload", "max_attempts", "request_id", "available_at")
    return rows.join(made.notifications.withColumnRenamed("job_id", "id"), "id")


@_query(
    "jobs notifications create_requests",
    f""", o AS (SELECT seq, type, queue, request_id, (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY seq) AS id, CASE WHEN seq % 4 = 0 THEN {T} + to_seconds(seq % 500 + 1) ELSE {T} END AS due FROM create_requests)
SELECT id, queue, CASE WHEN due > {T} THEN 'delayed' ELSE 'pending' END AS list, CASE WHEN due > {T} THEN due END AS score, (SELECT max(seq) FROM notifications) + row_number() OVER (PARTITION BY queue ORDER BY id) AS seq FROM o""",
)
def dispatch_and_notify(jobs, notifications, create_requests):
    when = F.when(F.col("seq") % 4 == 0, rules.after(_now(), F.col("seq") % 500 + 1))
    return dispatch.dispatch(jobs, notifications, create_requests.withColumn("available_at", when), _now()).notifications.withColumnRenamed("job_id", "id").select("id", "queue", "list", "score", "seq")


@_query("jobs notifications", "SELECT queue, list, job_id, seq FROM notifications n WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = n.job_id AND j.status IN ('pending', 'cancelled'))")
def cancel_with_notifications(jobs, notifications):
    return dispatch.cancel_jobs(jobs, notifications, jobs.select("id"), _now())[1].select("queue", "list", "job_id", "seq")


@_query(
    "jobs notifications",
    """ SELECT queue, job_id, list, seq FROM notifications UNION ALL
SELECT queue, id, 'pending', (SELECT max(seq) FROM notifications) + row_number() OVER (PARTITION BY queue ORDER BY id) FROM jobs WHERE status = 'failed'""",
)
def requeue_with_notification(jobs, notifications):
    return dispatch.requeue_jobs(jobs, notifications, jobs.select("id"), _now())[1].select("queue", "job_id", "list", "seq")


@_query("jobs notifications", "SELECT queue, list, count(*) AS n FROM notifications GROUP BY ALL")
def purge_with_notifications(jobs, notifications):
    noted = notify.enqueue(notifications, jobs.where("status = 'failed'").select("queue", F.col("id").alias("job_id"), F.col("id").alias("seq")))
    return dispatch.purge_jobs(jobs, noted, jobs.select("id"))[1].groupBy("queue", "list").agg(F.count("*").alias("n"))


# -- the worker's batch --------------------------------------------------------

_TAKE = f""", head AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq, job_id) AS r FROM notifications WHERE list = 'pending'),
taken AS (SELECT n.queue, n.job_id, n.seq, j.* EXCLUDE (queue), coalesce(j.status = 'pending' AND j.available_at <= {T}, false) AND n.job_id % 9 > 0 AS mine FROM head n LEFT JOIN jobs j ON j.id = n.job_id WHERE r <= 200)"""


def _without_some(jobs: DataFrame) -> DataFrame:
    """Jobs of which some were cancelled while their notifications stayed."""
    return jobs.withColumn("status", F.when((F.col("id") % 9 == 0) & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")))


@_query("jobs notifications", _TAKE + f" SELECT queue, job_id, CASE WHEN mine THEN 'processing' END AS list, CASE WHEN mine THEN sha256(concat_ws('|', CAST(job_id AS VARCHAR), 'w', '7')) END AS lease_token FROM taken")
def claim_from_queue(jobs, notifications):
    taken = worker.claim_from_queue(_without_some(jobs), notifications, 200, _now(), "w", 7)
    kept = taken.after.select("queue", "job_id", F.col("list").alias("kept"))
    met = taken.before.select("queue", "job_id").join(kept, ["queue", "job_id"], "left").join(taken.claims.select(F.col("id").alias("job_id"), "lease_token"), "job_id", "left")
    return met.select("queue", "job_id", F.col("kept").alias("list"), "lease_token")


_WORK = _TAKE + f""", y AS (SELECT *, CAST(json_extract_string(payload, '$.order') AS BIGINT) AS ord FROM taken WHERE mine),
z AS (SELECT *, type = 'mail.send' OR (type = 'invoice.generate' AND ord % 2 = 0) AS ok, least(pow(2, attempts + 1), 300) AS wait FROM y),
done AS (SELECT *, CASE WHEN ok THEN 'completed' WHEN attempts + 1 < max_attempts THEN 'pending' ELSE 'failed' END AS now_status FROM z)"""


@_query(
    "jobs notifications",
    _WORK + f""" SELECT job_id AS id, now_status AS status, CASE WHEN now_status = 'pending' THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN type = 'mail.send' THEN 100 ELSE progress END AS progress,
CASE WHEN type = 'mail.send' THEN 'sent' END AS progress_message, CASE WHEN now_status = 'pending' THEN 'delayed' END AS list, CASE WHEN now_status = 'pending' THEN {T} + to_seconds(CAST(wait AS INT)) END AS score FROM done""",
)
def run_worker_batch(jobs, notifications):
    done = worker.run_batch(_without_some(jobs), notifications, _handlers(), _now(), 200, "w", version=7)
    rows = done.jobs.select("id", "status", "attempts", "progress", "progress_message")
    return rows.join(done.after.select(F.col("job_id").alias("id"), "list", "score"), "id", "left")


@_query(
    "jobs notifications",
    _WORK + """, all_events AS (SELECT 'claimed' AS event, job_id FROM done UNION ALL SELECT CASE WHEN job_id % 11 = 0 THEN 'lost_ownership' WHEN now_status = 'pending' THEN 'retried' ELSE now_status END, job_id FROM done
UNION ALL SELECT 'infrastructure_failure', job_id FROM done WHERE type = 'mail.send' UNION ALL SELECT 'infra_error', NULL UNION ALL SELECT 'backoff', NULL)
SELECT event, count(*) AS n, count(job_id) AS jobs, CAST(0 AS BIGINT) AS bad FROM all_events GROUP BY event""",
)
def worker_events(jobs, notifications):
    done = worker.run_batch(_without_some(jobs), notifications, _handlers(), _now(), 200, "w", version=7)
    lost = done.jobs.select("id", "type", (F.col("id") % 11 > 0).cast("int").alias("affected"))
    unseen = events.heartbeat_failures(lost.where("type = 'mail.send'"))
    told = [events.claimed(lost, 1.5), events.settled(done.requests, lost, lost), unseen, events.loop_failure(jobs.sparkSession, "gone away", "ConnectionError", 2.5)]
    every = told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3]).withColumn("bad", events.event_error().isNotNull())
    return every.groupBy("event").agg(F.count("*").alias("n"), F.count("job_id").alias("jobs"), F.count_if("bad").alias("bad"))


# -- reconciliation ----------------------------------------------------------

_RECONCILE = f""", page AS (SELECT * FROM jobs WHERE status = 'pending' AND queue = '{QUEUE}' ORDER BY id LIMIT 1000),
e AS (SELECT *, CASE WHEN available_at <= {T} THEN 'pending' ELSE 'delayed' END AS expected FROM page),
newest AS (SELECT queue, job_id, row_number() OVER (PARTITION BY queue ORDER BY seq DESC, job_id DESC) AS r FROM notifications WHERE list = 'pending'),
known AS (SELECT DISTINCT queue, job_id, 'pending' AS list FROM newest WHERE r <= 250 UNION ALL SELECT DISTINCT queue, job_id, 'delayed' FROM notifications WHERE list = 'delayed'),
o AS (SELECT e.id, expected, CASE WHEN e.id < 1 THEN 'invalid' WHEN k.job_id IS NOT NULL THEN 'duplicate' ELSE 'restored' END AS outcome FROM e LEFT JOIN known k ON e.queue = k.queue AND e.id = k.job_id AND e.expected = k.list)"""


@_query("jobs notifications", _RECONCILE + " SELECT id, expected, outcome FROM o")
def reconcile_page(jobs, notifications):
    return reconcile.outcomes(reads.scan_pending(jobs, QUEUE, None, 1000), notifications, _now(), 250).select("id", "expected", "outcome")


@_query("jobs notifications", _RECONCILE + " SELECT outcome, count(*) AS n FROM o GROUP BY 1")
def reconcile_summary(jobs, notifications):
    done = reconcile.reconcile(jobs, notifications, QUEUE, _now(), None, rules.ReconcileOptions(page_size=1000))
    return reconcile.summary(done.rows)


# -- payloads and handlers ---------------------------------------------------


@_query("jobs", "SELECT id, CAST(json_extract_string(payload, '$.customer') AS BIGINT) AS customer, CAST(json_extract_string(payload, '$.order') AS BIGINT) AS order_key FROM jobs")
def payload_extract(jobs):
    got = jobs.select("id", F.from_json("payload", "customer bigint, order bigint").alias("p"))
    return got.select("id", F.col("p.customer").alias("customer"), F.col("p.order").alias("order_key"))


@_query("jobs", "SELECT id, id % 3 = 0 AS valid FROM jobs")
def payload_validate(jobs):
    odd = F.when(F.col("id") % 3 == 0, F.col("payload")).when(F.col("id") % 3 == 1, "[1]").otherwise("{broken")
    return jobs.select("id", rules.payload_object(odd).alias("valid"))


def _handlers() -> runner.Handlers:
    def mail(job_id, payload, progress):
        progress(100, "sent")
        return {"order": payload["order"]}

    def invoice(job_id, payload, progress):
        if payload["order"] % 2:
            raise ValueError("odd order")
        return None

    return runner.Handlers({"mail.send": mail, "invoice.generate": invoice})


_RUN = _CLAIM + """, x AS (SELECT j.*, CAST(json_extract_string(payload, '$.order') AS BIGINT) AS ord FROM jobs j JOIN claimed USING (id)),
y AS (SELECT *, type = 'mail.send' OR (type = 'invoice.generate' AND ord % 2 = 0) AS ok FROM x)"""


@_query("jobs", _RUN + " SELECT id, ok, CASE WHEN type = 'mail.send' THEN '{\"order\":' || CAST(ord AS VARCHAR) || '}' END AS result FROM y")
def run_handlers(jobs):
    held = jobs.join(claims.claim_next(jobs, _now(), 100, 4).select("id"), "id", "left_semi")
    return runner.execute(held, _handlers()).select("id", "ok", "result")


@_query("jobs", _RUN + " SELECT id, CASE WHEN ok THEN 'completed' WHEN attempts + 1 < max_attempts THEN 'pending' ELSE 'failed' END AS status, CASE WHEN NOT ok AND attempts + 1 < max_attempts THEN attempts + 1 ELSE attempts END AS attempts FROM y")
def run_and_settle(jobs):
    taken = claims.claim_next(jobs, _now(), 100, 4)
    after, _ = runner.process(jobs, taken, _handlers(), _now())
    return after.join(taken.select("id"), "id", "left_semi").select("id", "status", "attempts")


@_query("jobs", _RUN + " SELECT CASE WHEN ok THEN 'completed' WHEN attempts + 1 < max_attempts THEN 'retried' ELSE 'failed' END AS event, count(*) AS n FROM y GROUP BY 1")
def lifecycle_events(jobs):
    taken = claims.claim_next(jobs, _now(), 100, 4)
    held = claims.apply_claims(jobs, taken, _now())
    running = held.join(taken.select("id"), "id", "left_semi")
    requests = runner.requests_of(runner.execute(running, _handlers()), running, taken)
    told = events.settled(requests, jobs, transitions.settle(held, requests, _now()).select("id", "affected"))
    return reads.count_by(told, "event")


@_query("jobs", _CLAIM + " SELECT id, '\"outer(inner(' || type || '))\"' AS result FROM jobs JOIN claimed USING (id)")
def middleware_order(jobs):
    held = jobs.join(claims.claim_next(jobs, _now(), 100, 4).select("id"), "id", "left_semi")
    handlers = runner.Handlers(middleware=[lambda e, proceed: f"outer({proceed()})", lambda e, proceed: f"inner({proceed()})"])
    for kind in ("mail.send", "invoice.generate", "report.build"):
        handlers.register(kind, lambda job_id, payload, progress, kind=kind: kind)
    return runner.execute(held, handlers).select("id", "result")


# -- analyses ----------------------------------------------------------------


@_query("worker_events", "SELECT event, count(*) AS n, min(duration_ms) AS least, max(duration_ms) AS most, median(duration_ms) AS median FROM worker_events GROUP BY 1")
def event_stream_stats(worker_events):
    return tooling.event_stats(worker_events)


@_query("worker_events", "SELECT event, median(duration_ms) AS median, min(duration_ms) AS least, max(duration_ms) AS most, count(*) AS samples, 1000 / greatest(median(duration_ms), 1e-9) AS throughput FROM worker_events GROUP BY 1")
def benchmark_medians(worker_events):
    return tooling.benchmark_summary(worker_events, "event", "duration_ms", F.lit(1000))


@_query(
    "op_log",
    """, o AS (SELECT job_id, op, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS r FROM op_log),
f AS (SELECT job_id, CAST(0 AS BIGINT) AS r, 'none' AS status FROM (SELECT DISTINCT job_id FROM op_log)
UNION ALL SELECT o.job_id, o.r, CASE WHEN op = 'create' AND status IN ('none', 'completed', 'failed') THEN 'pending' WHEN op = 'claim' AND status = 'pending' THEN 'running'
WHEN op = 'complete' AND status = 'running' THEN 'completed' WHEN op = 'fail' AND status = 'running' THEN 'failed' ELSE status END FROM f JOIN o ON o.job_id = f.job_id AND o.r = f.r + 1)
SELECT job_id, arg_max(status, r) AS status, max(r) AS n_ops FROM f GROUP BY 1""",
)
def ledger_fold(log):
    return tooling.ledger_fold(log)


@_query(
    "documents",
    """WITH w AS (SELECT doc_id, source, list_filter(string_split(text, ' '), lambda t: t <> '') AS w FROM documents),
m AS (SELECT doc_id, source, unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i:i + 49], chr(1))))) AS fingerprint FROM w WHERE len(w) >= 50),
e AS (SELECT fingerprint, doc_id, source, count(*) AS n FROM m GROUP BY ALL)
SELECT fingerprint, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS documents, string_agg(DISTINCT source, ',' ORDER BY source) AS scopes,
array_to_string(list_transform(list_sort(list(doc_id))[1:3], lambda d: CAST(d AS VARCHAR)), ',') AS samples FROM e GROUP BY 1 HAVING count(*) >= 2""",
)
def duplicate_windows(documents):
    return tooling.duplicate_windows(documents, "doc_id", tooling.tokens(F.col("text")), F.col("source"))


@_query("documents", "SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def topk_documents(documents):
    return tooling.top(documents.select("doc_id", "n_chars", "source"), 20, F.desc("n_chars"), F.col("doc_id"))


@_query("documents", "SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY 1")
def scope_summary(documents):
    return documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@_query(
    "documents",
    """WITH c AS (SELECT source AS key, 'longest' AS metric, max(n_chars) AS value FROM documents GROUP BY 1),
b AS (SELECT source AS key, 'longest' AS metric, CAST(floor(avg(n_chars)) AS BIGINT) AS value FROM documents WHERE source <> 'src3' GROUP BY 1)
SELECT key, metric, coalesce(b.value, 5000) AS old, c.value AS new, CASE WHEN key = 'src1' THEN 'known' END AS allowed FROM c LEFT JOIN b USING (key, metric) WHERE c.value > coalesce(b.value, 5000)""",
)
def ratchet_diff(documents):
    of = lambda d, value: d.groupBy(F.col("source").alias("key")).agg(F.lit("longest").alias("metric"), value.alias("value")).select("key", "metric", "value")
    allowed = documents.sparkSession.createDataFrame([("src1", "*", "known"), ("src2", "longest", " ")], "key string, metric string, reason string")
    return tooling.ratchet(of(documents, F.max("n_chars")), of(documents.where("source <> 'src3'"), F.floor(F.avg("n_chars"))), {"longest": 5000}, allowed)


_RAW_ID = "CASE id % 4 WHEN 0 THEN '0' || CAST(id AS VARCHAR(20)) WHEN 1 THEN CAST(id AS VARCHAR(20)) || 'x' WHEN 2 THEN CAST(id AS VARCHAR(20)) ELSE repeat('9', 20) END"


@_query("jobs", f"SELECT queue, {_RAW_ID} AS raw_id, CASE WHEN id % 4 = 2 THEN id END AS job_id FROM jobs")
def malformed_ids(jobs):
    valid, malformed = notify.split_malformed(jobs.select("queue", F.expr(_RAW_ID).alias("raw_id")))
    return valid.unionByName(malformed, allowMissingColumns=True)


@_query("jobs notifications", "SELECT queue, id FROM jobs j WHERE status = 'pending' AND EXISTS (SELECT 1 FROM notifications n WHERE n.queue = j.queue AND n.job_id = j.id AND list = 'delayed')")
def has_delayed(jobs, notifications):
    asked = jobs.where("status = 'pending'").select("queue", F.col("id").alias("job_id"))
    return notify.has_delayed(notifications, asked).withColumnRenamed("job_id", "id")


@_query("notifications", f"SELECT queue, job_id, list FROM notifications WHERE queue <> '{QUEUE}'")
def clear_queue(notifications):
    return notify.clear(notifications, QUEUE).select("queue", "job_id", "list")


@_query("jobs", "SELECT id, CASE WHEN id % 3 > 0 THEN TIMESTAMP '1970-01-01 00:00:00' + to_seconds(id * 1000) END AS due FROM jobs")
def epoch_available_at(jobs):
    return jobs.select("id", ingest.from_epoch(F.when(F.col("id") % 3 > 0, F.col("id") * 1000)).alias("due"))


@_query("jobs", "SELECT id, CASE id % 5 WHEN 0 THEN 'type must not be blank' WHEN 1 THEN 'queue must not be blank' WHEN 2 THEN 'max_attempts must be at least 1' WHEN 3 THEN 'request_id must not be blank' END AS error FROM jobs")
def definition_errors(jobs):
    blank = lambda k, c: F.when(F.col("id") % 5 == k, " ").otherwise(F.coalesce(F.col(c), F.lit("x")))
    made = {"type": blank(0, "type"), "queue": blank(1, "queue"), "request_id": blank(3, "request_id"), "max_attempts": F.when(F.col("id") % 5 == 2, 0).otherwise(3)}
    return jobs.select("id", *(v.alias(c) for c, v in made.items())).select("id", ingest.definition_error().alias("error"))


@_query("jobs", f"SELECT id, CASE id % 3 WHEN 0 THEN available_at WHEN 1 THEN CAST(CAST(available_at AS DATE) AS TIMESTAMP) ELSE {T} END AS due FROM jobs")
def parsed_times(jobs):
    raw = F.when(F.col("id") % 3 == 0, F.date_format("available_at", "yyyy-MM-dd HH:mm:ss")).when(F.col("id") % 3 == 1, F.date_format("available_at", "yyyy-MM-dd")).otherwise("")
    return jobs.select("id", rules.parsed_time(raw, _now()).alias("due"))


@_query("jobs", "SELECT id, regexp_replace(queue, '[^a-zA-Z0-9_-]', '', 'g') AS lock, 'host:' || CAST(id AS VARCHAR) AS worker, progress IS NULL OR progress + 1 BETWEEN 0 AND 100 AS progress_ok, id % 3 = 0 AS infrastructure FROM jobs")
def policy_columns(jobs):
    raised = F.when(F.col("id") % 3 == 0, "redis.exceptions.ConnectionError").otherwise("builtins.ValueError")
    return jobs.select("id", rules.lock_name(F.col("queue")).alias("lock"), rules.worker_id(F.lit("host"), F.col("id")).alias("worker"), rules.progress_valid(F.col("progress") + 1).alias("progress_ok"), rules.infrastructure_error(raised).alias("infrastructure"))


@_query(
    "worker_events",
    """, m AS (SELECT event AS scenario, 'n' AS metric, count(*) AS value FROM worker_events GROUP BY 1),
b AS (SELECT * FROM (VALUES ('claimed', 'n', 10, false), ('completed', 'n', 1000000000000, false), ('failed', 'n', 1, true), ('absent', 'n', 5, false)) t(scenario, metric, most, exact))
SELECT scenario, metric, CAST(most AS BIGINT) AS most, exact, value FROM b LEFT JOIN m USING (scenario, metric) WHERE value IS NULL OR (exact AND value <> most) OR (NOT exact AND value > most)""",
)
def budget_violations(worker_events):
    measured = worker_events.groupBy(F.col("event").alias("scenario")).agg(F.lit("n").alias("metric"), F.count("*").alias("value"))
    budgets = [("claimed", "n", 10, False), ("completed", "n", 10**12, False), ("failed", "n", 1, True), ("absent", "n", 5, False)]
    return tooling.over_budget(measured, worker_events.sparkSession.createDataFrame(budgets, "scenario string, metric string, most long, exact boolean"))


@_query("documents", "SELECT source, count(*) FILTER (n_chars >= 500) * 100.0 / count(*) >= 50 AS met FROM documents GROUP BY 1")
def coverage_gate(documents):
    counts = documents.groupBy("source").agg(F.count(F.when(F.col("n_chars") >= 500, 1)).alias("covered"), F.count("*").alias("statements"))
    return counts.select("source", tooling.coverage_met(F.col("covered"), F.col("statements"), 50).alias("met"))


#: Bodies of source code, and their cyclomatic and cognitive complexity and nesting.
_SNIPPETS = (
    ("return $a ?? $b;", 2, 1, 0),
    ("$x = $a?->b(1) xor $c;", 2, 1, 0),
    ("if ($a && ($b || !$c)) { foreach ($d as $e) { $f += $e; } } elseif ($g) { return 1; } else { return 0; }", 6, 7, 2),
    ("do { $n--; } while ($n > 0); // if", 2, 2, 1),
    ("return $n < 2 ? $n : walk($n - 1) + walk($n - 2);", 2, 2, 0),
    ("switch ($k) { case 1: return 'if'; case 2: try { go(); } catch (E $e) { throw $e; } }", 4, 3, 2),
)


@_query(
    "jobs",
    "SELECT id, " + ", ".join(f"CAST(CASE id % {len(_SNIPPETS)} " + " ".join(f"WHEN {k} THEN {row[n]}" for k, row in enumerate(_SNIPPETS)) + f" END AS BIGINT) AS {name}" for n, name in ((1, "cyclomatic"), (2, "cognitive"), (3, "nesting"))) + " FROM jobs",
)
def code_metrics(jobs):
    body = F.element_at(F.array(*(F.lit(row[0]) for row in _SNIPPETS)), (F.col("id") % len(_SNIPPETS) + 1).cast("int"))
    return tooling.code_metrics(jobs.select("id", tooling.normalized_tokens(body).alias("tokens"), F.lit("Walk").alias("name")), "id", "tokens", "name")


# -- streams -----------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a stream, from files in the shared folder."""
    path = f"{shared_folder(spark)}/source-{name}-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _streamed(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    return stateful.run_available(stream, shared_folder(spark), mode)


def stream_event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, stateful.event_metrics(_stream(spark, sf_dir, "worker_events"), width="1 day"))


def stream_ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    stateful.use_rocksdb(spark)
    folded = stateful.fold_log(_stream(spark, sf_dir, "op_log"))
    path = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    stateful.each_batch(folded, stateful.into_folders(path), f"{path}-state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("job_id").agg(F.max(F.struct("n_ops", "status")).alias("last")).select("job_id", "last.status", "last.n_ops")


def _due_stream(spark: SparkSession, sf_dir: str, op: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    stateful.use_rocksdb(spark)
    return _streamed(spark, make(_stream(spark, sf_dir, "op_log").where(F.col("op") == op)))


def stream_lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _due_stream(spark, sf_dir, "claim", lambda rows: stateful.expired_leases(rows, 600))


def stream_promote_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = rules.after(F.col("ts"), F.col("seq") % 400 * 3600)
    return _due_stream(spark, sf_dir, "create", lambda rows: stateful.promoted(rows.withColumn("score", score)))


def stream_retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _due_stream(spark, sf_dir, "fail", lambda rows: stateful.retried(rows.withColumn("attempts", F.col("seq") % 12)))


def stream_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stateful.use_rocksdb(spark)
    requests = _stream(spark, sf_dir, "create_requests").select("seq", "request_id", (F.col("seq") % 18 == 0).alias("ended"))
    return _streamed(spark, stateful.idempotent(requests))


def _due_sql(op: str, due: str) -> str:
    """What is due by the watermark that the whole bounded source leaves."""
    return f"""{oracle_views("op_log")}, r AS (SELECT job_id, epoch_us(ts) // 1000 AS came, epoch_us({due}) // 1000 AS due FROM op_log WHERE op = '{op}'),
d AS (SELECT job_id, max({{'came': came, 'due': due}}) AS latest FROM r GROUP BY 1)
SELECT job_id, latest.due AS expired_at_ms FROM d WHERE latest.due <= (SELECT max(came) - 1000 FROM r)"""


_STREAM_ORACLES = {
    "stream_event_metrics": f"""{oracle_views("worker_events")} SELECT date_trunc('day', ts) AS start, event, count(*) AS n, CAST(sum(CAST(duration_ms AS DECIMAL(18, 6))) AS DOUBLE) AS total_ms
FROM worker_events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM worker_events)""",
    "stream_ledger_fold": _ORACLES["ledger_fold"],
    "stream_lease_expiry": _due_sql("claim", "ts + to_seconds(600)"),
    "stream_promote_delayed": _due_sql("create", "ts + to_seconds(seq % 400 * 3600)"),
    "stream_retry_backoff": _due_sql("fail", "ts + to_seconds(CAST(least(pow(2, seq % 12), 300) AS INT))"),
    "stream_idempotent": f"""{oracle_views("create_requests")}, r AS (SELECT seq, request_id, seq % 18 = 0 AS ended FROM create_requests),
g AS (SELECT *, count(*) FILTER (ended) OVER (PARTITION BY request_id ORDER BY seq) AS term FROM r),
m AS (SELECT *, min(seq) OVER (PARTITION BY request_id, term) AS maker FROM g WHERE NOT ended)
SELECT seq, request_id, maker, seq = maker AS created FROM m""",
}

_kinds()


def queries() -> dict[str, Query]:
    streams = (stream_event_metrics, stream_ledger_fold, stream_lease_expiry, stream_promote_delayed, stream_retry_backoff, stream_idempotent)
    return {**_QUERIES, **{f.__name__: f for f in streams}}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **_STREAM_ORACLES}
