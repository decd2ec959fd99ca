"""Scenarios of the ledger operators on small tables."""

import datetime as dt
import hashlib
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import rules
from ledgerline.operators import claims, dispatch, events, ingest, notify, reads, reconcile, recovery, runner, tooling, transitions, worker
from ledgerline.schema import CommitConflict, HandlerMissing, ModeUnavailable, SerializationError
from ledgerline.sources import ledger
from ledgerline.streaming import stateful

START = dt.datetime(2023, 11, 14, 22, 13, 20)


@pytest.fixture(autouse=True)
def _now(spark):
    global NOW
    NOW = rules.moment(str(START))


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def job(k, **fields):
    return {"id": k, "type": "t", "queue": "q", "available_at": START, "created_at": START, "updated_at": START} | fields


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def claimed(spark, **fields):
    jobs = ledger.checked(ledger.from_rows(spark, [job(1, **fields)]))
    taken = claims.claim_next(jobs, NOW, 1)
    return claims.apply_claims(jobs, taken, NOW), taken


def request(taken, kind, **extra):
    return taken.select("id", "lease_token", F.lit(kind).alias("kind"), *(F.lit(v).alias(k) for k, v in extra.items()))


def test_claims_take_due_jobs_in_order(spark):
    rows = [job(1, available_at=at(1)), job(2, available_at=at(0)), job(3, available_at=at(-5)), job(4, status="running"), job(5, queue="other"), job(6, available_at=at(-5))]
    got = claims.claim_next(ledger.from_rows(spark, rows), NOW, 2, 2).orderBy("queue", "rank").collect()
    assert [(r.id, r.worker_id) for r in got] == [(5, "worker-0"), (3, "worker-0"), (6, "worker-1")]
    assert len({r.lease_token for r in got}) == 3 and all(len(r.lease_token) == 64 for r in got)


def test_reclaim_by_the_same_worker_fences_the_old_token(spark):
    held, taken = claimed(spark)
    worker = one(taken).worker_id
    ask = lambda w: spark.createDataFrame([(1, w)], "id long, worker_id string")
    assert claims.claim_by_id(held, ask("someone"), NOW, 2).count() == 0
    again = claims.claim_by_id(held, ask(worker), NOW, 2)
    after = claims.apply_claims(held, again, NOW)
    assert one(transitions.settle(after, request(taken, "complete"), NOW)).affected == 0
    assert one(transitions.settle(after, request(again, "complete"), NOW)).affected == 1


def test_retry_keeps_progress_and_waits(spark):
    held, taken = claimed(spark)
    row = one(transitions.settle(held, request(taken, "retry", attempts=1, delay=60, error="e"), NOW))
    assert (row.status, row.attempts, row.available_at, row.locked_by, row.lease_token, row.error_message) == ("pending", 1, at(60), None, None, "e")
    later = transitions.settle(held, request(taken, "retry", attempts=1, delay=60), NOW).drop("affected")
    assert claims.claim_next(later, NOW, 1).count() == 0
    assert claims.claim_next(later, rules.after(NOW, 60), 1).count() == 1
    with pytest.raises(Exception, match="attempts must be"):
        transitions.settle(held, request(taken, "retry", attempts=0, delay=1), NOW).collect()
    with pytest.raises(Exception, match="progress must be"):
        transitions.settle(held, request(taken, "progress", progress=101), NOW).collect()


def test_terminal_states(spark):
    held, taken = claimed(spark, attempts=2)
    row = one(transitions.settle(held, request(taken, "fail", error="bad", trace="x" * 5000), NOW))
    assert (row.status, row.attempts, row.completed_at) == ("failed", 2, START) and row.error_trace == "x" * 4000 + "\n... [truncated]"
    row = one(transitions.settle(held, request(taken, "complete", result="1"), NOW))
    assert (row.status, row.result, row.lease_token) == ("completed", "1", None)
    row = one(transitions.settle(held, request(taken, "heartbeat"), rules.after(NOW, 9)))
    assert (row.status, row.locked_at) == ("running", at(9))


def test_stale_bound(spark):
    jobs = ledger.from_rows(spark, [job(1, max_attempts=2, status="running", locked_at=at(-301), lease_token="a"), job(2, status="running", locked_at=at(-300)), job(3, status="running")])
    rows = {r.id: r for r in recovery.recover_stale(jobs, 300, NOW).collect()}
    assert (rows[1].status, rows[1].attempts, rows[1].affected) == ("pending", 1, 1) and rows[2].affected == rows[3].affected == 0
    last = one(recovery.recover_stale(ledger.from_rows(spark, [job(1, max_attempts=2, attempts=1, status="running", locked_at=at(-301))]), 300, NOW))
    assert (last.status, last.attempts, last.completed_at) == ("failed", 1, START) and "stale" in last.error_message
    scoped = one(recovery.recover_stale_in_queue(ledger.from_rows(spark, [job(1, max_attempts=2, attempts=1, status="running", locked_at=at(-301))]), "q", 300, 5, NOW))
    assert (scoped.status, scoped.attempts, scoped.error_message) == ("failed", 2, None)
    with pytest.raises(ValueError):
        recovery.recover_stale(jobs, 0, NOW)


def test_cancel_requeue_purge_prune(spark):
    jobs = ledger.checked(ledger.from_rows(spark, [job(1), job(2, status="running"), job(3, status="failed", attempts=3, error_message="x"), job(4, status="completed", completed_at=at(-7 * 86400)), job(5, status="cancelled", completed_at=at(-7 * 86400 - 1)), job(6, status="failed", completed_at=at(-9999999))]))
    ids = jobs.select("id")
    assert {r.id: r.status for r in transitions.cancel(jobs, ids, NOW).collect()} == {1: "cancelled", 2: "running", 3: "failed", 4: "completed", 5: "cancelled", 6: "failed"}
    row = transitions.requeue_failed(jobs, ids, NOW).where("id = 3").first()
    assert (row.status, row.attempts, row.error_message, row.affected) == ("pending", 0, None, 1)
    assert {r.id for r in transitions.purge_failed(jobs, ids.where("id < 6")).collect()} == {1, 2, 4, 5, 6}
    assert {r.id for r in transitions.prune_completed(jobs, NOW).collect()} == {1, 2, 3, 4, 6}


def test_retry_delays(spark):
    exponents = spark.createDataFrame([(1,), (2,), (4,), (9,), (5000,)], "n int")
    assert [r[0] for r in exponents.select(rules.delay(2, F.col("n"), 300)).collect()] == [2, 4, 16, 300, 300]
    assert [r[0] for r in exponents.select(rules.delay(0, F.col("n"), 10)).collect()] == [0] * 5
    assert [r[0] for r in exponents.select(rules.delay(2, F.col("n"), 10)).collect()] == [2, 4, 10, 10, 10]


def test_hydration_defaults_and_errors(spark):
    raw = spark.createDataFrame([("1", None, "a", None, "{}", None), ("2", "q", "b", "odd", "{}", None), ("3", "q", "b", "failed", "[1]", None), ("4", "q", "b", "failed", "{x", None), ("5", "q", "b", "failed", "[]", "{y"), ("6", "q", "b", "failed", "[]", "")], "id string, queue string, type string, status string, payload string, result string")
    rows = {r.id: r for r in ledger.hydrate(raw).collect()}
    assert (rows[1].queue, rows[1].status, rows[1].max_attempts, rows[1]["_error"]) == ("default", "pending", 3, None)
    assert [rows[k]["_error"] is None for k in range(2, 7)] == [False, False, False, False, True]
    with pytest.raises(SerializationError):
        ledger.checked(ledger.hydrate(raw))


def test_batch_ids_are_contiguous(spark):
    jobs = ledger.from_rows(spark, [job(41)])
    new = spark.createDataFrame([(k * 70000, "t", None, at(120) if k else None) for k in (3, 0, 2, 1)], "seq long, type string, queue string, available_at timestamp_ntz")
    made = ingest.create_jobs(jobs, new, NOW).orderBy("id").collect()
    assert [r.id for r in made] == [42, 43, 44, 45] and [r.available_at for r in made] == [START, *[at(120)] * 3]
    assert {(r.queue, r.max_attempts, r.payload) for r in made} == {("default", 3, "{}")}
    for bad in ({"type": " "}, {"max_attempts": 0}, {"request_id": ""}):
        row = {"type": "t", "max_attempts": 1, "request_id": "r"} | bad
        with pytest.raises(ValueError):
            ingest.create_jobs(jobs, spark.createDataFrame([(1, *row.values())], "seq long, type string, max_attempts int, request_id string"), NOW)
    epochs = spark.createDataFrame([(1700000120,), (None,), (0,), (-5,)], "s long").select("s", ingest.from_epoch(F.col("s")).alias("t"))
    assert [r.t for r in epochs.where("s IS NULL OR s > 0").collect()] == [at(120), None]
    for bad in (0, -5):
        with pytest.raises(Exception, match="positive seconds"):
            epochs.where(F.col("s") == bad).collect()


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_numbers_in_groups_do_not_depend_on_blocks(spark, block):
    rows = [(("hot" if k % 3 else "q" if k % 2 else None), k * k % 1009 + 1009 * k) for k in range(60)]
    got = ingest.numbered(spark.createDataFrame(rows, "queue string, job_id long"), "job_id", 5, "seq", block, by="queue").collect()
    wanted = [(q, k, 5 + sum(p == q and j < k for p, j in rows)) for q, k in rows]
    assert sorted(((r.queue, r.job_id, r.seq) for r in got), key=str) == sorted(wanted, key=str)


def test_idempotent_creation(spark):
    jobs = ledger.from_rows(spark, [job(1, request_id="a"), job(2, status="completed", request_id="b")])
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "seq long, request_id string")
    got = {r.seq: (r.job_id, r.created) for r in ingest.idempotent(jobs, asked).collect()}
    assert got == {1: (1, False), 2: (3, True), 3: (3, False), 4: (4, True)}


def notes(spark, rows):
    return spark.createDataFrame(rows, "queue string, job_id long, list string, seq long, score timestamp_ntz")


def test_fifo_and_ties(spark):
    table = notes(spark, [("q", k, "pending", s, None) for s, k in enumerate((1, 2, 3))])
    assert [r.job_id for r in notify.dequeue(table, 2, NOW).where("moved").orderBy("seq").collect()] == [1, 2]
    delayed = notes(spark, [("q", 9, "delayed", 1, START), ("q", 10, "delayed", 2, START), ("q", 11, "delayed", 3, at(1))])
    assert [r.job_id for r in notify.promote_delayed(delayed, NOW, 1).where("moved").collect()] == [10]
    assert notify.promote_delayed(delayed, NOW).where("moved").count() == 2
    twice = notes(spark, [("q", 5, "processing", 1, START), ("q", 5, "pending", 2, None)])
    assert [r.list for r in notify.ack(twice, twice.select("queue", "job_id")).collect()] == ["pending"]
    assert notify.remove(twice, twice.select("queue", "job_id")).count() == 0
    with pytest.raises(Exception, match="delay"):
        notify.nack(twice, spark.createDataFrame([("q", 5, -1)], "queue string, job_id long, delay int"), NOW).collect()
    good, bad = notify.split_malformed(spark.createDataFrame([("q", x) for x in ("7", "07", "x", "9223372036854775808")], "queue string, raw_id string"))
    assert [r.job_id for r in good.collect()] == [7] and bad.count() == 3


def test_reconciliation_cursor_and_false_negatives(spark):
    jobs = spark.range(1, 1002).select(F.col("id"), F.lit("q").alias("queue"), F.lit("pending").alias("status"), NOW.alias("available_at"))
    none = notes(spark, [])
    options = rules.ReconcileOptions(page_size=1000)
    first = reconcile.reconcile(jobs, none, "q", NOW, None, options)
    assert (first.cursor, first.scanned, first.notifications.count()) == (1000, 1000, 1000)
    second = reconcile.reconcile(jobs, first.notifications, "q", NOW, first.cursor, options)
    assert (second.cursor, second.scanned) == (None, 1)
    wrapped = reconcile.reconcile(jobs.where("id <= 1000"), none, "q", NOW, 1000, options)
    assert (wrapped.cursor, wrapped.scanned) == (1000, 1000)
    few = notes(spark, [("q", k, "pending", k, None) for k in range(1, 5)])
    lossy = reconcile.reconcile(jobs.where("id <= 4"), few, "q", NOW, None, rules.ReconcileOptions(membership_limit=1))
    assert {r.outcome: r.n for r in reconcile.summary(lossy.rows).collect()} == {"duplicate": 1, "restored": 3}


def test_lifecycle_with_handlers_and_middleware(spark):
    jobs = ledger.checked(ledger.from_rows(spark, [job(1, type="ok", payload='{"n": 2}'), job(2, type="raise"), job(3, type="raise", attempts=2), job(4, type="none"), job(5, type="nan")]))
    seen = runner.Handlers(middleware=[lambda e, proceed: [e.attempts, proceed()]])
    seen.register("ok", lambda job_id, payload, progress: payload["n"] + 1)
    seen.register("nan", lambda *_: float("nan"))

    def fails(*_):
        raise RuntimeError("boom")

    seen.register("raise", fails)
    after, requests = runner.process(jobs, claims.claim_next(jobs, NOW, 10), seen, NOW)
    rows = {r.id: (r.status, r.attempts, r.result, r.error_message) for r in after.collect()}
    assert rows[1] == ("completed", 0, "[1,3]", None) and rows[2] == ("pending", 1, None, "boom") and rows[3] == ("failed", 2, None, "boom")
    assert all(r.progress is None for r in after.collect()) and rows[4][:2] == ("pending", 1) and "no handler" in rows[4][3] and rows[5][:2] == ("failed", 0)
    with pytest.raises(HandlerMissing):
        seen.get("gone")
    assert seen.types() == ["nan", "ok", "raise"]


def test_only_one_writer_commits_a_version(spark, tmp_path):
    store = ledger.LedgerStore(spark, str(tmp_path / "ledger"))
    rows = ledger.checked(ledger.from_rows(spark, [job(1), job(2)]))
    assert store.commit(rows, 0) == 1 and store.read().count() == 2
    won, lost = [], []

    def write():
        try:
            won.append(store.commit(rows, 1))
        except CommitConflict:
            lost.append(1)

    threads = [threading.Thread(target=write) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert (len(won), len(lost)) == (1, 2)
    assert store.update(lambda jobs: jobs.where("id = 1")) == 3 and store.read().count() == 1 and store.read(1).count() == 2


def test_options_and_modes():
    assert rules.WorkerOptions.parse({"poll_timeout": "7", "retry_max_delay": "x"}).poll_timeout == 7
    for bad in ({"stuck_job_ttl": 0}, {"promote_limit": 0}, {"retry_base_delay": 9, "retry_max_delay": 3}):
        with pytest.raises(ValueError):
            rules.WorkerOptions(**bad)
    assert ledger.notification_mode(" AUTO ", False) == "derived"
    with pytest.raises(ModeUnavailable):
        ledger.notification_mode("materialized", False)
    assert rules.connection_lost("2006", "") and rules.connection_lost(None, "MySQL server has gone away") and not rules.connection_lost("1", "syntax")


def test_code_metrics_and_windows(spark):
    sources = {
        "function f($a) { if ($a && $b) { return 1; } else { foreach ($x as $y) { if ($y) { return 'z'; } } } }": (5, 8, 3),
        "$a ?? $b": (2, 1, 0), "$a?->b": (1, 0, 0), "$a xor $b": (2, 1, 0), "$a ? $b : $c": (2, 0, 0), "": (1, 0, 0), "} } { }": (1, 0, 0),
        "if ($a) { if ($b) { x(); } } if ($c) { y(); }": (4, 4, 2), "/* if ( */ 'if' // while\n# catch\n if ($a) { }": (2, 1, 1),
        "if ($a) { $f = [1]; $g = function () { while (1) { } }; }": (3, 3, 2),
    }
    rows = spark.createDataFrame(list(enumerate(sources)), "key long, s string").select("key", tooling.normalized_tokens(F.col("s")).alias("tokens"))
    got = {r.key: (r.cyclomatic, r.cognitive, r.nesting) for r in tooling.code_metrics(rows).collect()}
    assert got == dict(enumerate(sources.values()))
    assert rows.where("key = 0").first().tokens[:5] == ["function", "f", "(", "<variable>", ")"] and "<literal>" in rows.where("key = 0").first().tokens
    assert tooling.code_metrics(rows.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a", "x y z w"), (2, "b", "q x y z"), (3, "b", "x y z x y z")], "k long, s string, t string")
    got = one(tooling.duplicate_windows(docs, "k", F.split("t", " "), F.col("s"), size=3).where("documents = 3"))
    assert (got.occurrences, got.scopes, got.samples) == (4, "a,b", "1,2,3")


def test_only_shared_windows_move_and_move_once(spark, capsys):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("a b c a\x01b é".split(" ")) for _ in range(draw.randint(0, 60))) for _ in range(25)]
    rows = [(draw.choice([None, 3, k]), draw.choice([None, "s", f"s{k % 3}"]), draw.choice([None, "", *texts])) for k in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:3], (77, "x", "lone " * 9), (78, None, "null " * 9), (79, None, "null " * 9)], "k long, s string, t string")
    for size in (1, 2, 5):
        found = {}
        for r in docs.collect():
            w = [t for t in (r.t or "").split(" ") if t]
            for i in range(len(w) - size + 1):
                found.setdefault(hashlib.sha256("\x01".join(w[i : i + size]).encode()).hexdigest(), []).append((r.k, r.s))
        wanted = set()
        for print_, at in found.items():
            keys, scopes = sorted(k for k, _ in set(at) if k is not None), sorted({s for _, s in at if s is not None})
            if len(set(at)) > 1:
                wanted.add((print_, len(at), len(set(at)), ",".join(scopes) if scopes else None, ",".join(map(str, keys[:3]))))
        got = tooling.duplicate_windows(docs, "k", tooling.tokens(F.col("t")), F.col("s"), size)
        assert wanted and {tuple(r) for r in got.collect()} == wanted
    got.explain()
    assert capsys.readouterr().out.split("Initial Plan")[0].count("Exchange hashpartitioning(fingerprint") == 1


def test_reads(spark):
    jobs = ledger.from_rows(spark, [job(k, status="failed" if k % 2 else "pending") for k in range(1, 8)])
    assert [r.id for r in reads.list_jobs(jobs, limit=2, offset=1).collect()] == [6, 5]
    assert [r.id for r in reads.scan_pending(jobs, "q", 2, 5).collect()] == [4, 6] and one(reads.count_jobs(jobs, "failed")).n == 4
    with pytest.raises(ValueError):
        reads.scan_pending(jobs, "q", None, 0)


def batches(spark, tmp_path, name, schema, parts):
    """A stream with a micro-batch for each of the parts."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        for f in (tmp_path / name).glob("*.parquet"):
            if f.stat().st_mtime > 1e9:  # not dated yet
                os.utime(f, (k + 1000, k + 1000))
    stateful.use_rocksdb(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def test_creation_keeps_its_state_over_micro_batches(spark, tmp_path):
    parts = [[(1, "a", False), (2, "a", False), (3, "b", False)], [(4, "a", False), (5, "b", True), (6, "b", False)], [(7, "a", True)], [(8, "a", False)]]
    stream = batches(spark, tmp_path, "requests", "seq long, request_id string, ended boolean", parts)
    got = stateful.run_available(stateful.idempotent(stream), str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.maker, r.created) for r in got] == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 1, False), (6, 6, True), (8, 8, True)]


def test_a_later_row_moves_a_timer(spark, tmp_path):
    # job 1 is renewed before its lease ends; job 2 ends; job 3 is still held
    parts = [[(1, at(0)), (2, at(0))], [(1, at(50))], [(3, at(120))], [(3, at(149))]]
    stream = batches(spark, tmp_path, "claims", "job_id long, ts timestamp_ntz", parts)
    got = stateful.run_available(stateful.expired_leases(stream, 60), str(tmp_path)).orderBy("job_id").collect()
    start = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert [(r.job_id, r.expired_at_ms - start) for r in got] == [(1, 110_000), (2, 60_000)]


def test_the_fold_does_not_depend_on_its_slices(spark):
    ops = ["create", "claim", "create", "fail", "complete", "create", "claim", "complete", "heartbeat"]
    log = spark.createDataFrame([(k, at(k * 7), j, op) for j in (1, 2) for k, op in enumerate(ops[: 9 - 4 * (j - 1)])], "seq long, ts timestamp_ntz, job_id long, op string")
    for seconds in (1, 20, 3600):
        got = {r.job_id: (r.status, r.n_ops) for r in tooling.ledger_fold(log, seconds).collect()}
        assert got == {1: ("completed", 9), 2: ("failed", 5)}


def test_delayed_members_and_clearing(spark):
    held = spark.createDataFrame([("q", 1, "delayed"), ("q", 2, "pending"), ("r", 1, "pending")], "queue string, job_id long, list string")
    asked = held.select("queue", "job_id")
    assert [tuple(r) for r in notify.has_delayed(held, asked).collect()] == [("q", 1)]
    assert [r.queue for r in notify.clear(held, "q").collect()] == ["r"] and notify.clear(held).count() == 0


def test_inventory_of_files(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "a.php").write_text("<?php\n// class No {\nfinal class A extends B\n{\n    abstract function none();\n    /** a\n     b */\n    public function run($x)\n    {\n        $f = function () { return A::class; };\n        return 'a {';\n    }\n    function Two() { if ($x) { Two(); } }\n}\ninterface I { }\nfunction free() { }\n")
    (tmp_path / "src" / "b.txt").write_text("class Not { }")
    files = tooling.source_files(spark, str(tmp_path))
    assert files.count() == 1
    rows = {(r.kind, r["class"], r.method): r for r in tooling.inventory(files).collect()}
    assert set(rows) == {("class", "A", None), ("class", "I", None), ("method", "A", "run"), ("method", "A", "Two")}
    assert {k[1:]: (r.first_line, r.lines) for k, r in rows.items()} == {("A", None): (3, 12), ("I", None): (15, 1), ("A", "run"): (8, 5), ("A", "Two"): (13, 1)}
    assert rows["method", "A", "Two"].tokens == ["if", "(", "<variable>", ")", "{", "two", "(", ")", ";", "}"]
    methods = tooling.inventory(files).where("kind = 'method'")
    assert {r.method: (r.cyclomatic, r.cognitive, r.nesting) for r in tooling.code_metrics(methods, "method", "tokens", "method").collect()} == {"run": (1, 0, 0), "Two": (2, 2, 1)}
    assert tooling.inventory(files.limit(0)).count() == 0


def test_requests_that_repeat_count_once(spark):
    held, taken = claimed(spark)
    both = request(taken, "progress", progress=10, seq=1).unionByName(request(taken, "progress", progress=40, seq=2))
    assert one(transitions.settle(held, both, NOW)).progress == 40
    row = one(transitions.settle(held, both.unionByName(request(taken, "complete", result="1", seq=3), allowMissingColumns=True), NOW))
    assert (row.status, row.result, row.affected) == ("completed", "1", 1)
    stale = request(taken, "fail", error="late", seq=0).withColumn("lease_token", F.lit("old"))
    assert one(transitions.settle(held, stale.unionByName(request(taken, "complete", seq=9), allowMissingColumns=True), NOW)).status == "completed"
    one(transitions.settle(held, stale.unionByName(stale), NOW))


def test_repeated_notifications_move_once(spark):
    twice = notes(spark, [("q", 5, "processing", 1, at(-900)), ("q", 5, "processing", 2, at(-900)), ("q", 6, "pending", 3, None), ("q", 7, "pending", 4, None)])
    back = recovery.recover_stale_processing(twice, 600, NOW)
    assert sorted((r.job_id, r.list, r.seq, r.moved) for r in back.collect()) == [(5, "pending", 5, True), (5, "pending", 6, True), (6, "pending", 3, False), (7, "pending", 4, False)]
    assert [r.job_id for r in notify.oldest_pending(back.drop("moved", "was"), 4).orderBy("seq").collect()] == [6, 7, 5, 5]  # behind those that wait
    assert len(recovery.repair_unscored(notes(spark, [("q", 5, "processing", 1, None)] * 1 + [("q", 5, "processing", 2, None)]), NOW, 9).collect()) == 2
    asked = spark.createDataFrame([("q", 5, 0), ("q", 5, 3)], "queue string, job_id long, delay int")
    assert sorted((r.job_id, r.list, r.seq) for r in notify.nack(twice, asked, NOW).collect()) == [(5, "pending", 5), (5, "processing", 2), (6, "pending", 3), (7, "pending", 4)]
    late = notes(spark, [("q", 5, "processing", 1, START), ("q", 5, "delayed", 2, at(99))])
    row = one(notify.nack(late, asked.where("delay > 0"), NOW))
    assert (row.list, row.score, row.seq, row.moved) == ("delayed", at(3), 3, True)


def test_dispatch_and_administration(spark):
    jobs = ledger.checked(ledger.from_rows(spark, [job(1), job(2, status="cancelled"), job(3, status="failed"), job(4, status="running", request_id="r")]))
    table = notes(spark, [("q", k, "pending", k, None) for k in (1, 2, 3, 4)])
    payloads = spark.createDataFrame([(1, "{}"), (2, "[]")], "seq long, payload string")
    made = dispatch.dispatch_batch(jobs, table, payloads, "t", NOW, "q", due=rules.after(NOW, 60))
    assert [(r.id, r.request_id, r.available_at) for r in made.jobs.orderBy("id").collect()] == [(5, None, at(60)), (6, None, at(60))]
    assert [(r.job_id, r.list, r.seq, r.score) for r in made.notifications.orderBy("seq").collect()] == [(5, "delayed", 5, at(60)), (6, "delayed", 6, at(60))]
    assert {r.list for r in dispatch.dispatch_batch(jobs, table, payloads, "t", NOW).notifications.collect()} == {"pending"}
    for bad in ((" ", "q", 1), ("t", "", 1), ("t", "q", 0)):
        with pytest.raises(ValueError):
            dispatch.dispatch_batch(jobs, table, payloads, bad[0], NOW, bad[1], bad[2])
    asked = spark.createDataFrame([(1, "t", "q", "r"), (2, "t", "q", "n"), (3, "t", "q", "n")], "seq long, type string, queue string, request_id string")
    answers, made = dispatch.dispatch_idempotent(jobs, table, asked, NOW)
    assert {r.seq: (r.job_id, r.created) for r in answers.collect()} == {1: (4, False), 2: (5, True), 3: (5, False)}
    assert [(r.id, r.request_id) for r in made.jobs.collect()] == [(5, "n")] and [r.job_id for r in made.notifications.collect()] == [5]
    after, left = dispatch.cancel_jobs(jobs, table, jobs.select("id"), NOW)
    assert sorted(r.job_id for r in left.collect()) == [3, 4] and [r.id for r in after.where("affected = 1").collect()] == [1]
    after, left = dispatch.requeue_jobs(jobs, table, jobs.select("id"), NOW)
    assert sorted((r.job_id, r.seq) for r in left.collect()) == [(1, 1), (2, 2), (3, 3), (3, 5), (4, 4)]
    after, left = dispatch.purge_jobs(jobs, table, jobs.select("id"))
    assert sorted(r.job_id for r in left.collect()) == [1, 2, 4] and after.count() == 3


def test_fields_of_events(spark):
    rows = spark.createDataFrame([(1, "t")], "id long, type string")
    good = events.claimed(rows, 2.0).unionByName(events.heartbeat_failures(rows)).unionByName(events.loop_failure(spark, "e", "E", 1.0))
    assert [r.e for r in good.select(events.event_error().alias("e")).collect()] == [None] * 4
    odd = events.event(rows, "claimed", job_id=F.col("id"), error=F.lit("x")).unionByName(events.event(rows, "gone")).unionByName(events.event(rows, F.lit(None).cast("string")))
    assert [r.e for r in odd.select(events.event_error().alias("e")).collect()] == ["without type,acquire_latency_ms", "unknown event", "unknown event"]
    heard = []
    events.listen([good], heard.append)
    assert heard[0] == {"event": "claimed", "job_id": 1, "type": "t", "acquire_latency_ms": 2.0} and [h["event"] for h in heard[1:]] == ["infrastructure_failure", "infra_error", "backoff"]
    assert events.records(good).first().fields == '{"job_id":1,"type":"t","acquire_latency_ms":2.0}'


def test_changes_are_committed_in_proportion(spark, tmp_path):
    store = ledger.LedgerStore(spark, str(tmp_path / "s"))
    jobs = ledger.checked(ledger.from_rows(spark, [job(k, payload='{"x": "' + "y" * 50 + str(k) + '"}') for k in range(1, 3001)]))
    table = notes(spark, [("q", k, "pending", k, None) for k in range(1, 3001)])
    assert store.commit(jobs, 0, "all", table) == 1
    files = lambda: {f: f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet")}
    before = files()

    def change(tables):
        some = tables["jobs"].where("id <= 100").withColumn("status", F.lit("cancelled"))
        gone = tables["notifications"].where("job_id <= 100")
        return {"jobs": (some, None), "notifications": (gone.withColumn("list", F.lit("delayed")).where("job_id > 50"), gone)}

    assert store.transact(change) == 2
    written = sum(size for f, size in files().items() if f not in before)
    assert written < sum(before.values()) / 5
    assert store.read().where("status = 'cancelled'").count() == 100 and store.read().count() == 3000 and store.read(1).where("status = 'cancelled'").count() == 0
    assert {r["list"]: r["count"] for r in store.read(table="notifications").groupBy("list").count().collect()} == {"pending": 2900, "delayed": 50}
    back = store.read(table="notifications").where("list = 'delayed'")
    assert store.commit_changes({"notifications": (back.withColumn("list", F.lit("pending")), back)}, 2) == 3  # the same keys as once
    assert store.read(table="notifications").where("list = 'pending'").count() == 2950
    with pytest.raises(CommitConflict):
        store.commit_changes({"jobs": (store.read().limit(1), None)}, 2)
    store.most_deltas = 1
    assert store.commit_changes({"jobs": (None, store.read().where("id = 1").select("*"))}, 3) == 5  # and a snapshot
    assert store.read().count() == 2999 and store.read(table="notifications").count() == 2950 and not store._commit(5)["jobs"]["deltas"]


def test_a_failed_write_is_no_conflict(spark, tmp_path, monkeypatch):
    store = ledger.LedgerStore(spark, str(tmp_path / "s"))
    rows = ledger.checked(ledger.from_rows(spark, [job(1)]))

    class Fails:
        def create(self, *_):
            raise PermissionError("denied")

        def delete(self, *_):
            pass

        def exists(self, *_):
            return False

    monkeypatch.setattr(store, "_fs", Fails())
    with pytest.raises(PermissionError):
        store.commit(rows, 0)
    assert ledger.available(spark, str(tmp_path)) and not ledger.available(spark, str(tmp_path / "gone")) and not ledger.available(spark, "nothing://x/y")


def test_small_sources_and_sinks(spark, tmp_path):
    rows = ledger.checked(ledger.from_rows(spark, [job(k, status="failed" if k == 2 else "pending") for k in (1, 2, 3)]))
    ledger.write_json(rows.select("id", "status"), str(tmp_path / "j"))
    assert [r.id for r in ledger.read_json(spark, str(tmp_path / "j"), "id long, status string").orderBy("id").collect()] == [1, 2, 3]
    (tmp_path / "bad.json").write_text("{x")
    with pytest.raises(Exception):
        ledger.read_json(spark, str(tmp_path / "bad.json"), "id long").collect()
    assert [r.id for r in ledger.find_jobs(spark, rows, "q", "pending", 2, 5).collect()] == [3]
    assert ledger.find_jobs(spark, rows, "q' OR '1' = '1", "pending", 0, 5).count() == 0
    assert reads.everything(rows).count() == 3 and ingest.create_jobs(reads.cleared(rows), spark.createDataFrame([(1, "t")], "seq long, type string"), NOW).first().id == 1
    tries = []

    def lost():
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("MySQL server has gone away")
        return "there"

    assert rules.with_reconnect(lost, lambda: tries.append(2)) == "there" and tries == [1, 2, 1]
    tries.clear()
    with pytest.raises(RuntimeError):
        rules.with_reconnect(lost)
    with pytest.raises(ZeroDivisionError):
        rules.with_reconnect(lambda: 1 / 0, lambda: tries.append(9))
    assert tries == [1]


def test_reconciliation_stops_when_its_time_is_over(spark):
    jobs = ledger.from_rows(spark, [job(k) for k in (1, 2, 3)])
    ticks = iter(range(100))
    done = reconcile.reconcile(jobs, notes(spark, []), "q", NOW, None, rules.ReconcileOptions(time_limit=3), lambda: next(ticks), 1)
    assert (done.scanned, done.cursor) == (2, 2) and sorted(r.job_id for r in done.restored.collect()) == [1, 2]
    rest = reconcile.reconcile(jobs, done.notifications, "q", NOW, done.cursor)
    assert (rest.scanned, rest.cursor) == (1, None) and [(r.job_id, r.seq) for r in rest.restored.collect()] == [(3, 3)]
    late = iter([0, 9])
    none = reconcile.reconcile(jobs, notes(spark, []), "q", NOW, 1, None, lambda: next(late))
    assert (none.scanned, none.cursor, none.rows.count()) == (0, 1, 0)


def test_a_slow_page_is_reconciled_whole(spark, monkeypatch):
    jobs, spent = ledger.from_rows(spark, [job(k) for k in (1, 2, 3)]), []

    def slow(*page):
        spent.append(9)
        return reads.scan_pending(*page)

    monkeypatch.setattr(reconcile, "scan_pending", slow)
    done = reconcile.reconcile(jobs, notes(spark, []), "q", NOW, None, rules.ReconcileOptions(time_limit=1), lambda: sum(spent))
    assert (done.scanned, done.cursor, done.rows.count()) == (3, None, 3)


class Clock:
    def __init__(self):
        self.now, self.slept = START.replace(tzinfo=dt.timezone.utc).timestamp(), []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def _worker(spark, path, rows, table, **options):
    store = ledger.LedgerStore(spark, path)
    store.commit(ledger.checked(ledger.from_rows(spark, rows)), 0, "", notes(spark, table))
    clock, heard = Clock(), []

    def odd(job_id, payload, progress):
        progress(30, "on it")
        if job_id % 2:
            raise ValueError("odd")
        return job_id

    handlers = runner.Handlers({"t": odd, "nan": lambda *_: float("nan")})
    return worker.Worker(store, "q", handlers, rules.WorkerOptions(**options), heard.append, 2, "me", clock, clock.sleep), clock, heard


def test_worker_runs_until_nothing_is_left(spark, tmp_path):
    rows = [job(1), job(2), job(3, attempts=2), job(4, type="nan"), job(5, status="cancelled"), job(6, queue="other"), job(7, status="running", locked_at=at(-9999), locked_by="x", lease_token="t", attempts=1)]
    table = [("q", k, "pending", k, None) for k in (1, 2, 3, 4, 5)] + [("other", 6, "pending", 6, None)]
    work, clock, heard = _worker(spark, str(tmp_path / "s"), rows, table, stop_when_empty=True, retry_base_delay=2)
    assert work.run() == 5  # job 7 was recovered and reconciled
    got = {r.id: (r.status, r.attempts, r.progress, r.error_message) for r in work.store.read().collect()}
    assert got[1] == ("pending", 1, 30, "odd") and got[2] == ("completed", 0, 30, None) and got[3] == ("failed", 2, 30, "odd")
    assert got[4][0] == "failed" and got[5][0] == "cancelled" and got[6][0] == "pending" and got[7][0] == "failed"
    left = sorted((r.queue, r.job_id, r.list, r.score) for r in work.store.read(table="notifications").collect())
    assert left == [("other", 6, "pending", None), ("q", 1, "delayed", at(2))]
    assert sorted((h["event"], h["job_id"]) for h in heard) == [("claimed", k) for k in (1, 2, 3, 4, 7)] + [("completed", 2), ("failed", 3), ("failed", 7), ("retried", 1)]
    assert all(h.get("duration_ms", 0) >= 0 for h in heard)
    clock.now += 2
    assert work.process_one() and not work.process_one()  # the retry is due
    assert {r.id: r.attempts for r in work.store.read().collect()}[1] == 2


def test_worker_stops_at_its_limits(spark, tmp_path):
    rows, table = [job(2 * k) for k in range(1, 8)], [("q", 2 * k, "pending", k, None) for k in range(1, 8)]
    work, clock, _ = _worker(spark, str(tmp_path / "a"), rows, table, max_jobs=3)
    assert work.run() == 3 and work.store.read().where("status = 'completed'").count() == 3
    work, clock, _ = _worker(spark, str(tmp_path / "b"), rows[:1], table[:1], max_time=8, poll_timeout=5)
    assert work.run() == 1 and clock.slept == [5, 5]
    work.options = rules.WorkerOptions(memory_limit=10)
    work.memory = lambda: 10
    assert work.run() == 0


def test_worker_backs_off_and_maintains(spark, tmp_path, monkeypatch):
    work, clock, heard = _worker(spark, str(tmp_path / "s"), [job(2)], [("q", 2, "pending", 1, None)], stop_when_empty=True, retry_base_delay=2, retry_max_delay=5, promote_interval=1, recovery_interval=3600)
    step, calls, promoted, recovered = work.step, [], [], []
    plan = [ConnectionError("gone"), ConnectionError("gone"), ValueError("odd"), ConnectionError("gone")]

    def fails(*a):
        calls.append(1)
        if len(calls) <= len(plan):
            raise plan[len(calls) - 1]
        return step(*a)

    monkeypatch.setattr(work, "step", fails)
    monkeypatch.setattr(work, "promote", lambda: promoted.append(clock()))
    monkeypatch.setattr(work, "recover", lambda: recovered.append(clock()))
    assert work.run() == 1 and work.errors == 0
    assert [int(s) for s in clock.slept] == [2, 4, 1, 5] and len(promoted) == 5 and len(recovered) == 1
    assert [h["event"] for h in heard] == ["infra_error", "backoff"] * 3 + ["claimed", "completed"]
    assert [int(h["backoff_seconds"]) for h in heard if h["event"] == "backoff"] == [2, 4, 5] and heard[0]["exception_class"] == "ConnectionError"


def test_a_batch_that_fails_leaves_the_queue_as_it_was(spark, tmp_path):
    work, _, heard = _worker(spark, str(tmp_path / "s"), [job(2)], [("q", 2, "pending", 1, None)])
    other = ledger.LedgerStore(spark, str(tmp_path / "s"))
    keep = work.store.keep

    def raced(df):  # another writer commits while the batch runs
        if other.current() == 1:
            other.commit_changes({"jobs": (other.read().withColumn("progress", F.lit(1)), None)}, 1)
        return keep(df)

    work.store.keep = raced
    with pytest.raises(CommitConflict):
        work.step()
    assert work.store.read(table="notifications").first()["list"] == "pending" and work.store.read().first().status == "pending" and not heard
    assert work.step() == 1 and work.store.read().first().status == "completed"


def test_a_ledger_in_a_database(spark):
    """The embedded database that comes with Spark stands for any JDBC source."""
    rows = ledger.checked(ledger.from_rows(spark, [job(1, request_id="r"), job(2, status="failed")])).select("id", "queue", "type", "status", "payload", "attempts", "max_attempts", "request_id")
    url, driver = "jdbc:derby:memory:ledger;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows.write.format("jdbc").options(url=url, dbtable="jobs", driver=driver).mode("overwrite").save()
    got = ledger.checked(ledger.read_jdbc(spark, url, "jobs", driver=driver)).orderBy("id").collect()
    assert [(r.id, r.status, r.request_id, r.max_attempts, r.locked_by) for r in got] == [(1, "pending", "r", 3, None), (2, "failed", None, 3, None)]
