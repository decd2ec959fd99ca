"""Reading and writing ledgers, and the commit protocol of snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import payload_object
from ..schema import DEFAULTS, JOB_COLUMNS, JOB_SCHEMA, NOTIFICATION_SCHEMA, STATUSES, CommitConflict, ModeUnavailable, SerializationError


def from_rows(spark: SparkSession, rows: list) -> DataFrame:
    """A ledger of rows in memory: dicts with any of the columns."""
    return hydrate(spark.createDataFrame([tuple(r.get(c) for c in JOB_COLUMNS) for r in rows], JOB_SCHEMA))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A ledger in a database, by whatever JDBC driver is on the class path."""
    return hydrate(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def hydrate(raw: DataFrame) -> DataFrame:
    """Typed rows with defaults for nulls, and ``_error`` where a row is bad."""
    have = {c.lower() for c in raw.columns}
    typed = []
    for field in JOB_SCHEMA:
        value = F.col(field.name).try_cast(field.dataType) if field.name in have else F.lit(None).cast(field.dataType)
        typed.append((F.coalesce(value, F.lit(DEFAULTS[field.name])) if field.name in DEFAULTS else value).alias(field.name))
    rows = raw.select(*typed)
    error = F.when(~F.col("status").isin(*STATUSES), "unknown status").when(~payload_object(F.col("payload")), "payload is no JSON object")
    error = error.when((F.length(F.trim("result")) > 0) & F.expr("try_parse_json(result)").isNull(), "result is no JSON")
    return rows.withColumn("_error", error)


def checked(jobs: DataFrame) -> DataFrame:
    """The rows of a hydrated ledger; an error as soon as one of them is bad."""
    bad = jobs.where(F.col("_error").isNotNull()).select("id", "_error").limit(1).collect()
    if bad:
        raise SerializationError(f"job {bad[0].id}: {bad[0]['_error']}")
    return jobs.select(*JOB_COLUMNS)


def export(jobs: DataFrame) -> DataFrame:
    return jobs.select(*JOB_COLUMNS)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What :func:`write_json` wrote; a line that is no JSON object is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader if schema is None else reader.schema(schema)).json(path)


def find_jobs(spark: SparkSession, jobs: DataFrame, queue: str, status: str, least_id: int, limit: int) -> DataFrame:
    """A page by bound values, which never become part of the statement's text."""
    return spark.sql(
        "SELECT * FROM {jobs} WHERE queue = :queue AND status = :status AND id >= :least ORDER BY id LIMIT :most", {"queue": queue, "status": status, "least": least_id, "most": limit}, jobs=jobs
    )


def available(spark: SparkSession, path: str) -> bool:
    """Whether a store or table can be reached at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))
    except Exception:  # noqa: BLE001  no such file system, or it does not answer
        return False


def notification_mode(name: str, has_table: bool) -> str:
    """``materialized`` notifications, or those ``derived`` from the ledger."""
    chosen = name.strip().lower()
    if chosen == "auto":
        return "materialized" if has_table else "derived"
    if chosen == "derived":
        return chosen
    if chosen == "materialized" and has_table:
        return chosen
    raise ModeUnavailable(f"notification mode {name!r} is not available")


#: Table: its schema, and what tells its rows apart.
TABLES = {"jobs": (JOB_SCHEMA, ["id"]), "notifications": (NOTIFICATION_SCHEMA, ["queue", "job_id", "list", "seq"])}


class LedgerStore:
    """Jobs and notifications in versions, each of which one writer can commit.

    A version is what its commit file says: of each table a snapshot and the
    changes since, in order.  A commit of changes writes files of the rows that
    changed and no others; a reader takes the snapshot without the keys that
    changed and the last state of those.  After :attr:`most_deltas` of them a
    commit writes a snapshot again.  Files go through Hadoop's file system, so
    any store that Spark reads will do whose ``create`` without overwriting is
    atomic.
    """

    most_deltas = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/_commits")
        if not self._fs.exists(at):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json"))

    def current(self) -> int:
        return max(self.versions(), default=0)

    def _commit(self, version: int) -> dict:
        if not version:
            return {t: {"snapshot": None, "deltas": []} for t in TABLES}
        stream = self._fs.open(self._path(f"{self.path}/_commits/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["tables"]
        finally:
            stream.close()

    def read(self, version: int | None = None, table: str = "jobs") -> DataFrame:
        """A table as of a version, without one as of the last."""
        held = self._commit(self.current() if version is None else version)[table]
        schema, keys = TABLES[table]
        rows = self.spark.read.schema(schema).parquet(held["snapshot"]).select(*schema.names) if held["snapshot"] else self.spark.createDataFrame([], schema)
        if not held["deltas"]:
            return rows
        changed = T.StructType([*schema, T.StructField("_gone", T.BooleanType()), T.StructField("_version", T.LongType())])
        last = self.spark.read.schema(changed).parquet(*held["deltas"])
        # a key may leave and come again in one version: what is there counts
        last = last.groupBy(*keys).agg(F.max(F.struct("_version", (~F.col("_gone")).alias("_there"), *(c for c in schema.names if c not in keys))).alias("_last"))
        there = last.where("_last._there").select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in schema.names))
        return rows.join(last.select(*keys), keys, "left_anti").select(*schema.names).unionByName(there)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written beside the tables and read back."""
        path = f"{self.path}/_work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _snapshot(self, table: str, rows: DataFrame, version: int) -> str:
        path = f"{self.path}/{table}-v{version}-{uuid.uuid4().hex}"
        rows = rows.select(*TABLES[table][0].names)
        if table == "jobs":
            rows.sortWithinPartitions("queue", "available_at", "id").write.partitionBy("status").parquet(path)
        else:
            rows.sortWithinPartitions("queue", "seq").write.partitionBy("list").parquet(path)
        return path

    def _write(self, version: int, tables: dict, note: str, made: list[str]) -> int:
        """The commit file; :class:`CommitConflict` if another writer has made it."""
        try:
            out = self._fs.create(self._path(f"{self.path}/_commits/{version}.json"), False)
        except Exception as e:
            for path in made:
                self._fs.delete(self._path(path), True)
            if "FileAlreadyExistsException" in str(e):
                raise CommitConflict(f"version {version} is there already") from e
            raise
        out.write(bytearray(json.dumps({"tables": tables, "base": version - 1, "note": note}).encode()))
        out.close()
        return version

    def commit(self, jobs: DataFrame, base: int, note: str = "", notifications: DataFrame | None = None) -> int:
        """Whole tables as version ``base + 1``; notifications that are not given
        stay as they are."""
        tables, made = self._commit(base), []
        for table, rows in (("jobs", jobs), ("notifications", notifications)):
            if rows is not None:
                made.append(self._snapshot(table, rows, base + 1))
                tables[table] = {"snapshot": made[-1], "deltas": []}
        return self._write(base + 1, tables, note, made)

    def commit_changes(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], base: int, note: str = "") -> int:
        """Of each table the rows that are new or changed, and those that are
        gone, as version ``base + 1``."""
        tables, made = self._commit(base), []
        for table, (rows, gone) in changes.items():
            names = TABLES[table][0].names
            parts = [df.select(*names, F.lit(flag).alias("_gone")) for df, flag in ((rows, False), (gone, True)) if df is not None]
            if not parts:
                continue
            both = reduce(DataFrame.unionByName, parts).withColumn("_version", F.lit(base + 1).cast("long"))
            path = f"{self.path}/{table}-d{base + 1}-{uuid.uuid4().hex}"
            both.coalesce(8).write.parquet(path)
            made.append(path)
            tables[table]["deltas"].append(path)
        version = self._write(base + 1, tables, note, made)
        if any(len(t["deltas"]) > self.most_deltas for t in tables.values()):
            try:
                return self.compact(version)
            except CommitConflict:  # a faster writer goes on; a later commit compacts
                return version
        return version

    def compact(self, base: int) -> int:
        """Version ``base`` again, as snapshots."""
        return self.commit(self.read(base), base, "compact", self.read(base, "notifications"))

    def transact(self, change: Callable[[dict], dict], note: str = "", tries: int = 2) -> int:
        """Commits ``change({"version", "jobs", "notifications"})``, whose result
        is that of :meth:`commit_changes`, computed anew on what a faster writer left."""
        for left in reversed(range(tries)):
            base = self.current()
            try:
                return self.commit_changes(change({"version": base, **{t: self.read(base, t) for t in TABLES}}), base, note)
            except CommitConflict:
                if not left:
                    raise
        raise AssertionError

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 2, note: str = "") -> int:
        """Commits the ledger ``change(jobs)``, computed anew on what a faster writer left."""
        for left in reversed(range(tries)):
            base = self.current()
            try:
                return self.commit(change(self.read(base)), base, note)
            except CommitConflict:
                if not left:
                    raise
        raise AssertionError
