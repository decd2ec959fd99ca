"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, forest, langid, license_scan, packing, quality, quotes, secret_scan, sql, tiff, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(_documents(spark, sf_dir)), limits=token_counts.powers_of_two(spark, 7, 20))


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digests(_documents(spark, sf_dir))


def op3_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_spans(secret_scan.scan_documents(_documents(spark, sf_dir)))


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.lookup(_documents(spark, sf_dir))


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted_folds(_documents(spark, sf_dir))


def op9_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.jaccard_join(_documents(spark, sf_dir))


def op10_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_tiff_pages, op3_balanced_packing, op4_chunked_bpe, op5_secret_scan, op6_license_digests, op7_quotation_links, op8_language_crf, op9_jaccard_forest, op10_adaptive_quality, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_license_digests": license_scan.lookup_sql(), "op7_quotation_links": sql.QUOTATION_LINKS, "op9_jaccard_forest": sql.JACCARD_JOIN, "op10_adaptive_quality": sql.adaptive_quality()}
