"""A corpus pipeline: five stages, each on what the one before it kept.

language     documents without a known language go
quality      documents that fail the base rules or their source's and language's thresholds go
near copies  of each class of near copies one document stays
secrets      what looks like a secret is masked in the text
packing      the texts' tokens are packed into sequences of at most 1024

The stages run in one session after another, on executors that keep what each of
them has taken; so each asks the session for small batches of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import forest, langid, packing, quality, secret_scan
from ledgerline.llm.shared import small_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` whose text has a language; all columns stay.

    The field is learned from the labelled rows outside the fold 1.  Null text,
    empty text and text without a letter has no language and goes; a null lang
    or doc_id is no reason to go; repeated rows go or stay together; long texts
    are read whole.  Without a labelled row nothing is known and all rows go.
    Extra columns of any name stay; an empty table gives an empty one.
    """
    small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` that pass the base rules and their group's bounds.

    Null and empty texts have under 20 words and go; null lang and null source
    are groups like others; a rate equal to its bound stays; repeated rows go or
    stay together; long texts are counted whole.  Extra columns of any name
    stay; an empty table gives an empty one.
    """
    small_batches(spark)
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal and near texts the row of least doc_id.

    Null text counts as empty, so of all null and empty texts one row stays;
    a null doc_id comes after all others; of rows that share doc_id and text
    one stays; texts are compared whole.  Extra columns of any name stay; an
    empty table gives an empty one.
    """
    small_batches(spark)
    return forest.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of ``docs``, with what looks like a secret masked in ``text`` and
    ``n_chars`` counted anew where that changed it.

    Null text stays null, empty text empty; spans that overlap share one mask;
    repeated rows are masked alike; long texts are read whole.  Extra columns of
    any name stay; an empty table gives an empty one.
    """
    small_batches(spark)
    return secret_scan.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows of ``docs`` in sequences, see ``pack_documents``.

    A null or empty text is one token, the end; null and repeated doc_ids are
    documents of their own; of documents of one length the earlier goes first;
    a long text fills sequences of its own.  Other columns are not looked at;
    an empty table gives no pieces.
    """
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("quality", quality_rules), ("near_copies", near_copies), ("secrets", secrets), ("packing", pack)]

#: Language models, signatures and merges are beyond SQL; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
