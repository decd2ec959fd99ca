"""Times the headline queries, and operators over all the jobs they can act on;
prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import rules
from ledgerline.operators import claims, dispatch, ingest, notify, reconcile, recovery, runner, transitions
from ledgerline.plans import registry
from ledgerline.sources.fixtures import NOW, view

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "count_by_status_queue scan_pending_keyset claim_next_topk claim_after_state settle_after_state recover_stale_all prune_completed create_jobs_batch dispatch_idempotent "
    "fifo_dequeue promote_delayed reconcile_summary run_and_settle event_stream_stats ledger_fold"
).split()


def timed(make: Callable[[], DataFrame]) -> float:
    """Median seconds of three runs after one that warms up."""
    samples = []
    for _ in range(4):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        samples.append(time.perf_counter() - began)
    return round(statistics.median(samples[1:]), 4)


def throughput(spark: SparkSession) -> dict[str, dict[str, float]]:
    """Jobs that each operator changes or makes, and how many in a second."""
    now, late = rules.moment(NOW), rules.moment("1999-01-01 00:00:00")
    jobs, notes = view(spark, SF_DIR, "jobs"), view(spark, SF_DIR, "notifications")
    due, every = jobs.where(claims.due(now)), 10**9
    owned = jobs.where("status = 'running'").select("id", "lease_token", F.lit("complete").alias("kind"), F.lit("1").alias("result"))
    new = jobs.select(F.col("id").alias("seq"), "type", "queue", "payload")
    pending = jobs.where("status = 'pending'")
    handlers = runner.Handlers({kind: lambda job_id, payload, progress: payload["order"] for kind in ("mail.send", "invoice.generate", "report.build")})
    taken = lambda: claims.claim_next(jobs, now, every, 4)

    def work() -> DataFrame:
        held = claims.apply_claims(jobs, taken(), now, touched=True)
        requests = runner.requests_of(runner.execute(held, handlers), held, held.select("id", "lease_token"))
        return transitions.settle(held, requests, now, touched=True)

    cases: dict[str, tuple[Callable[[], DataFrame], DataFrame]] = {
        "create_batch": (lambda: ingest.create_jobs(jobs, new, now), new),
        "dispatch_batch": (lambda: dispatch.dispatch(jobs, notes, new, now).notifications, new),
        "claim": (lambda: claims.apply_claims(jobs, taken(), now, touched=True), due),
        "run_and_settle": (work, due),
        "settle": (lambda: transitions.settle(jobs, owned, now, touched=True), owned),
        "requeue_failed": (lambda: transitions.requeue_failed(jobs, jobs.where("status = 'failed'"), now).where("affected = 1"), jobs.where("status = 'failed'")),
        "recover_stale": (lambda: recovery.recover_stale(jobs, 600, now).where("affected = 1"), jobs.where("status = 'running'").where(F.col("locked_at") < rules.before(now, 600))),
        "reconcile": (lambda: reconcile.outcomes(pending, notes, now, 250), pending),
        "dequeue": (lambda: notify.dequeue(notes, every, now).where("moved"), notes.where("list = 'pending'")),
        "promote_delayed": (lambda: notify.promote_delayed(notes, late, every).where("moved"), notes.where("list = 'delayed'").where(F.col("score") <= late)),
    }
    out = {}
    for name, (make, acted) in cases.items():
        seconds, n = timed(make), acted.count()
        out[name] = {"jobs": n, "sec": seconds, "jobs_per_second": round(n / max(seconds, 1e-9))}
    return out


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    took = {name: timed(lambda name=name: queries[name](spark, SF_DIR)) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "throughput": throughput(spark)}))


if __name__ == "__main__":
    main()
