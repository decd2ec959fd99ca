"""Tables in the shared folder, and fresh column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here,
    and the loss of an executor costs no recomputation of what stands before."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch where several operators share a session's executors.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python at most this much at a time, so that
    neither an executor's buffers nor its workers keep room for 10,000 texts."""
    for name, most in BATCH.items():
        spark.conf.set(name, most)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Parts into which the rows of one key are dealt for a join.
SALTS = 16


def salt(*columns: str) -> Column:
    """The part of a row, by what tells the rows of a key apart."""
    return F.pmod(F.xxhash64(*columns, F.lit(5)), F.lit(SALTS)).cast("int")


def salts(part: str) -> Column:
    """Aggregate of a column of parts: those that a key has, as bits."""
    return F.bit_or(F.expr(f"shiftleft(1, {part})"))


def each_salt(bits: str) -> Column:
    """The parts that the bits name, as rows: the other side of a join by key
    and part, which has a key's row once for each part that is there."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit(F.col(bits), k) == 1))


def join_in_parts(rows: DataFrame, others: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``others``, which have a row for each key at most.
    The rows of a key, told apart by the columns ``by``, meet it in parts, so a
    key that very many rows share is no single task's.  ``rows`` are read twice."""
    part, bits = fresh(rows, "part"), fresh(rows, "bits")
    rows = rows.withColumn(part, salt(*by))
    there = rows.groupBy(*keys).agg(salts(f"`{part}`").alias(bits))
    others = others.join(there, keys).select(*others.columns, each_salt(bits).alias(part))
    return rows.join(others, [*keys, part], how).drop(part)
