"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, default_ranks
from .shared import stored


def encoded_lengths(docs: DataFrame, text: str = "text", ranks: tuple[str, str] | None = None) -> DataFrame:
    """One column, n_tokens long: the tokens of each row's whole text (null: 0).
    Repeated rows count each, other columns are not looked at, and an empty
    table gives an empty one."""
    ranks = ranks or default_ranks()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*ranks)
        for batch in batches:
            counts = [len(own.encode(x.as_py() or "")) // 4 for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 1024, limits: DataFrame | None = None) -> DataFrame:
    """Histogram with prefix and suffix sums, from a column ``n_tokens``.

    One row for each length that occurs, and for each of ``limits(context)``
    that is not null or negative: n_tokens, n_docs (0 for a limit that is no
    length), docs_up_to (of at most this length), docs_over, tokens_up_to,
    tokens_over, truncated_total (tokens that stay when every document is cut
    to this length), total_tokens, total_docs and quantile (share of documents
    of at most this length).  Null lengths count as 0; repeated limits are one;
    no rows give no rows, and limits alone have null quantiles.

    Counting is a partial aggregate, so a length that a third of all documents
    share is one row of each task.  The counts are written out, so the texts are
    encoded once though the counts are read twice.  A limit stands among the
    lengths as one of no documents, so its answers are prefix sums, too.  The sums run in two levels: within blocks
    of ``block`` lengths, and over the blocks' totals, which are as many as the
    longest document's length over ``block``.
    """
    counts = lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    if limits is not None:
        asked = limits.select(F.col("context").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs")).where("n_tokens >= 0")
        counts = counts.unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    counts = stored(counts).withColumn("block", F.floor(F.col("n_tokens") / block))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    up_to = (
        counts.withColumns({"d": F.sum("n_docs").over(within), "t": F.sum(F.col("n_docs") * F.col("n_tokens")).over(within)})
        .join(blocks, "block")
        .withColumns({"docs_up_to": F.col("docs_before") + F.col("d"), "tokens_up_to": F.col("tokens_before") + F.col("t")})
    )
    over = F.col("total_docs") - F.col("docs_up_to")
    return up_to.select(
        "n_tokens",
        "n_docs",
        "docs_up_to",
        over.alias("docs_over"),
        "tokens_up_to",
        (F.col("total_tokens") - F.col("tokens_up_to")).alias("tokens_over"),
        (F.col("tokens_up_to") + over * F.col("n_tokens")).alias("truncated_total"),
        "total_tokens",
        "total_docs",
        (F.col("docs_up_to") / F.when(F.col("total_docs") > 0, F.col("total_docs"))).alias("quantile"),
    )


def at_limits(lengths: DataFrame, limits: DataFrame) -> DataFrame:
    """Answers for each distinct ``limits(context)``: docs_over (longer than it)
    and truncated_total, from the column ``n_tokens``.  Every answer is a suffix
    sum of the histogram, and exact.  Null or negative limits are left out; of
    no documents both answers are 0."""
    asked = limits.select(F.col("context").cast("long").alias("context")).where("context >= 0").distinct()
    return asked.join(length_histogram(lengths, limits=asked).withColumnRenamed("n_tokens", "context"), "context").select("context", "docs_over", "truncated_total")


def powers_of_two(spark: SparkSession, least: int = 7, most: int = 40) -> DataFrame:
    """The usual context limits, as ``context``."""
    return spark.range(least, most + 1).select(F.expr("shiftleft(1L, cast(id AS int))").alias("context"))


def length_at(histogram: DataFrame, quantile: float) -> DataFrame:
    """The least length that at least this share of the documents do not exceed
    (one row, null on an empty histogram)."""
    return histogram.where("n_docs > 0").where(F.col("docs_up_to") >= F.lit(quantile) * F.col("total_docs")).agg(F.min("n_tokens").alias("n_tokens"))
