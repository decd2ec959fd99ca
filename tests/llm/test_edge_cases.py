"""Every operator and stage on nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

import pytest

import corpus_pipeline
from ledgerline.llm import bpe, forest, langid, license_scan, packing, quality, quotes, secret_scan, tiff, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "on the first day of the week we went to see the old house by the river where nobody had lived for many years now"
ROWS = [
    (1, PLAIN, "en", "a", 10), (1, PLAIN, "en", "a", 10), (2, PLAIN, "en", None, None), (3, None, None, None, None), (4, "", "en", "a", 0),
    (None, PLAIN + " again", None, "a", 3), (None, None, None, None, None), (5, "x" * 200_000, "en", "b", 1), (6, "word " * 30_000, "de", "b", 1),
    (7, "password = Zk3vQ9tLx2Wm8r", "en", "a", 1), (8, "퟿\u0000 é 日本 😀", "ja", "a", 1), (9, " \n\t ", "en", "a", 1),
]
CLASHES = ("id", "key", "ids", "form", "root", "brief", "keys", "media", "page", "error", "spans", "score", "kept", "_kept", "n_words", "base_failed", "limit_group", "text_id", "license_id", "a b", "start", "task")

ON_DOCUMENTS = {
    "op1": lambda d: token_counts.encoded_lengths(d),
    "op2": lambda d: tiff.media_digests(d),
    "op4": lambda d: bpe.digest_documents(d),
    "op5": lambda d: secret_scan.digest_spans(secret_scan.scan_documents(d)),
    "op6": lambda d: license_scan.lookup(d),
    "op8": lambda d: langid.predicted_folds(d),
    "op9": lambda d: forest.jaccard_join(d),
    "op10": lambda d: quality.judged(d),
}


def odd(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHES:
        docs = docs.withColumn(name, token_counts.F.col("n_chars"))
    return docs.withColumn("deep", token_counts.F.struct(token_counts.F.lit(1).alias("odd name"), token_counts.F.array("source").alias("list")))


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_a_row_for_each_document(spark, name):
    """Each operator of this kind gives one row per row, whatever stands in it."""
    got = ON_DOCUMENTS[name](odd(spark)).collect()
    assert len(got) == len(ROWS)
    if name != "op1":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
        ones = [tuple(r) for r in got if r.doc_id == 1]
        assert ones[0] == ones[1]
    assert ON_DOCUMENTS[name](odd(spark).limit(0)).collect() == []


def test_packing_and_histogram(spark):
    pieces = packing.pack_documents(odd(spark)).collect()
    assert sum(p.length for p in pieces if p.doc_id in (3, 4)) == 2  # the end id of a null and of an empty text
    assert packing.pack_documents(odd(spark).limit(0)).collect() == []
    lengths = token_counts.encoded_lengths(odd(spark))
    histogram = token_counts.length_histogram(lengths).collect()
    assert sum(r.n_docs for r in histogram) == len(ROWS) and min(r.n_tokens for r in histogram) == 0
    assert token_counts.length_histogram(lengths.limit(0)).collect() == []
    assert token_counts.length_histogram(spark.createDataFrame([(None,), (2,)], "n_tokens long")).count() == 2


def test_quotes(spark):
    rows = [("c", 1, "user", PLAIN), ("c", 2, "user", f"> {PLAIN}\nyes"), ("c", 2, "user", f"> {PLAIN}\nyes"), (None, 1, None, f"> {PLAIN}"), ("c", None, "user", None), ("d", 1, "user", ""), ("d", 2, "user", ">" * 50_000 + " x"), ("d", 3, "user", "> " * 3 + "\n" * 20_000)]
    talk = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    for name in ("source", "hash", "level", "thread", "reply_to", "own", "quotes"):
        talk = talk.withColumn(name, token_counts.F.lit(1))
    got = quotes.link_quotes(talk).collect()
    assert len(got) == len(rows)
    assert [r.reply_to for r in got if r.conv_id == "c" and r.turn == 2] == [1, 1]
    assert all(r.reply_to is None for r in got if r.conv_id != "c" or r.turn != 2)
    assert quotes.link_quotes(talk.limit(0)).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    docs = odd(spark).where("deep IS NOT NULL")
    out = stage(spark, docs, "")
    empty = stage(spark, docs.limit(0), "")
    assert empty.collect() == []
    if name == "packing":
        assert out.agg({"length": "sum"}).first()[0] > 0
        return
    assert out.columns == docs.columns == empty.columns
    kept = out.collect()
    assert 0 < len(kept) <= len(ROWS)
    if name == "secrets":
        assert len(kept) == len(ROWS) and all("Zk3vQ9tLx2Wm8r" not in (r.text or "") for r in kept)
    if name == "near_copies":
        assert len([r for r in kept if r.text == PLAIN]) == 1 and len({r.text or "" for r in kept}) == len(kept)
