"""Streams over the ledger: leases, due times, idempotent creation, the fold of
its log, and event metrics.

State is kept by the RocksDB provider, keyed as the batch operators group, so a
hot queue is split by job wherever the operator allows it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import after, delay

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a bounded source has, through the query, into Parquet files."""
    spark, name = stream.sparkSession, uuid.uuid4().hex
    out = f"{path.rstrip('/')}/stream-{name}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_metrics(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of each event in windows of event time; an extension.

    Sums are taken in decimals, so they do not depend on the order of rows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n"), F.sum(F.col("duration_ms").cast("decimal(18,6)")).cast("double").alias("total_ms")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event", "n", "total_ms")


class _Fold(StatefulProcessor):
    """Status of a job; an operation that does not fit its status is lost."""

    NEXT = {("none", "create"): "pending", ("completed", "create"): "pending", ("failed", "create"): "pending", ("pending", "claim"): "running", ("running", "complete"): "completed", ("running", "fail"): "failed"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, n = self.state.get() or ("none", 0)
        ops = [x for part in rows for x in zip(part["ts"], part["seq"], part["op"], strict=True)]
        for _, _, op in sorted(ops):
            status, n = self.NEXT.get((status, op), status), n + 1
        self.state.update((status, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n_ops": [n]})

    def close(self) -> None:
        pass


def fold_log(log: DataFrame) -> DataFrame:
    """``log(seq, ts, job_id, op)`` to a row per job and batch with its status.

    The operations of a batch act in order of (ts, seq), and batches in the order
    in which they come: an operation that comes a batch late acts late, as it
    would on a ledger.  ``tooling.ledger_fold`` orders the whole log."""
    return log.groupBy("job_id").transformWithStateInPandas(_Fold(), "job_id long, status string, n_ops long", "Update", "None")


class _Timers(StatefulProcessor):
    """A timer of each job, set by its latest row: (at, due) in milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.last.get()
        last = max([*([tuple(old)] if old else []), *(pair for part in rows for pair in zip(part["at"].tolist(), part["due"].tolist(), strict=True))])
        if old:
            self.handle.deleteTimer(old[1])
        self.handle.registerTimer(last[1])
        self.last.update(last)
        yield pd.DataFrame({"job_id": [], "expired_at_ms": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "expired_at_ms": [due]})

    def close(self) -> None:
        pass


def due_times(rows: DataFrame, due: Column, late: str = "1 second") -> DataFrame:
    """``rows(job_id, ts)`` to the jobs whose time ``due`` has come, and that time.

    Of a job's rows the latest by ts counts (of equal ones the latest due), so
    the order of arrival does not matter.  Times are UTC.
    """
    millis = lambda time: F.unix_millis(time.cast("timestamp"))
    timed = rows.select("job_id", F.col("ts").cast("timestamp").alias("ts"), millis(F.col("ts")).alias("at"), millis(due).alias("due")).withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(_Timers(), "job_id long, expired_at_ms long", "Append", "EventTime")


def expired_leases(claims: DataFrame, ttl: int, late: str = "1 second") -> DataFrame:
    """``claims(job_id, ts)``, heartbeats among them, to leases that nothing has
    renewed for ttl seconds."""
    return due_times(claims, after(F.col("ts"), ttl), late)


def promoted(delayed: DataFrame, late: str = "1 second") -> DataFrame:
    """``delayed(job_id, ts, score)`` to the jobs whose score has come."""
    return due_times(delayed, F.col("score"), late)


def retried(failures: DataFrame, base: int = 2, cap: int = 300, late: str = "1 second") -> DataFrame:
    """``failures(job_id, ts, attempts)``, attempts counted with this one, to the
    jobs whose backoff is over."""
    return due_times(failures, after(F.col("ts"), delay(base, F.col("attempts"), cap)), late)


class _Creation(StatefulProcessor):
    """The seq of the request that has created the job a request id stands for,
    until a job of it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        active = self.active.get()
        active = active[0] if active else None
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.ended:
                active = None
                continue
            created = active is None
            active = row.seq if created else active
            out.append((row.seq, key[0], active, created))
        if active is None:
            self.active.clear()
        else:
            self.active.update((active,))
        yield pd.DataFrame(out, columns=["seq", "request_id", "maker", "created"])

    def close(self) -> None:
        pass


def idempotent(requests: DataFrame) -> DataFrame:
    """``requests(seq, request_id, ended)`` to each one's maker and created."""
    return requests.groupBy("request_id").transformWithStateInPandas(_Creation(), "seq long, request_id string, maker long, created boolean", "Append", "None")


def each_batch(stream: DataFrame, change: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``change`` on every micro-batch: the worker loop over a stream."""
    return stream.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint)


def into_folders(path: str) -> Callable[[DataFrame, int], None]:
    """For :func:`each_batch`: every micro-batch has a folder of its own, which a
    batch that runs again writes anew."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
