"""Quality rules whose thresholds come from quantile sketches.

The sketch is that of Masson, Rim and Lee, "DDSketch" (2019): a value falls in
a bucket of the powers of ``(1 + a) / (1 - a)``, so every quantile is right
within the relative error ``a``, and sketches merge by adding counts.  In that
form a sketch is a partial aggregate: no value is gathered anywhere, the result
does not depend on the order of merging, and a lost task changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .columns import _SOLID, runs, slices, span_hashes, text_bytes, windows, words
from .shared import fresh, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: Rates of a document.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
#: A document is far out beyond so many interquartile ranges.
SPREAD = 6.0
#: Words of a window: a repeat is two of them, so words come in clumps of twice that.
WINDOW = 8
ERROR = 0.01
#: Documents below which a group's quartiles are not its own to set.
LEAST_GROUP = 20
#: Groups up to which the thresholds are broadcast: at most some 100 bytes each.
BROADCAST_GROUPS = 50_000


def measure(column: pa.Array, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The :data:`COUNTS` of each text of an Arrow column."""
    data, offsets = text_bytes(column)
    out = {name: np.zeros(len(offsets) - 1, np.int64) for name in COUNTS}
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        solid = _SOLID[part]
        sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        per_row = lambda flags: np.diff(sums(flags)[at])  # noqa: B023, E731
        hashes, first, end = words(part, at)
        out["n_words"][a:b] = end - first
        out["word_chars"][a:b] = per_row(solid & ((part & 0xC0) != 0x80))
        out["n_symbols"][a:b] = per_row(_SYMBOL[part])
        # lines with a word, and those equal to an earlier one of their row
        starts, ends = runs(part != 10, at)
        worded = sums(solid)
        has = worded[ends] > worded[starts]
        starts, ends = starts[has], ends[has]
        row = np.searchsorted(at, starts, "right") - 1
        out["n_lines"][a:b] = np.bincount(row, minlength=b - a)
        repeated = _later(row, span_hashes(part, starts, ends))
        out["n_dup_lines"][a:b] = np.bincount(row[repeated], minlength=b - a)
        # words within windows that their row has twice
        row = np.repeat(np.arange(b - a), end - first)
        grams = windows(hashes, window)
        inside = np.flatnonzero(row[: len(grams)] == row[window - 1 :]) if len(grams) else np.zeros(0, np.int64)
        often = inside[_often(row[inside], grams[inside])]
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, often, 1)
        np.add.at(cover, often + window, -1)
        out["n_repeat_words"][a:b] = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=b - a)
    return out


def _ranked(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by row and value, and which elements equal the one before."""
    order = np.lexsort((value, row))
    same = np.zeros(len(order), bool)
    same[1:] = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    return order, same


def _later(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Elements that equal an earlier one of their row."""
    order, same = _ranked(row, value)
    return order[same]


def _often(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Elements of values that their row has twice or more."""
    order, same = _ranked(row, value)
    if len(same):
        same[:-1] |= same[1:]
    return order[same]


def with_counts(docs: DataFrame, names: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with the :data:`COUNTS` under the given names."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = measure(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[n]) for n in COUNTS)], [*batch.schema.names, *(names[n] for n in COUNTS)])

    return docs.mapInArrow(count, StructType([*docs.schema, *(StructField(names[n], LongType()) for n in COUNTS)]))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def rates(names: dict[str, str]) -> dict[str, Column]:
    """Rates of a document; a document without words or lines has rate 0."""
    c = {n: F.col(names[n]) for n in COUNTS}
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    found = share(c["n_symbols"], c["n_words"]), share(c["n_dup_lines"], c["n_lines"]), share(c["n_repeat_words"], c["n_words"]), share(c["word_chars"], c["n_words"])
    return dict(zip(RATES, found, strict=True))


def sure_rates(names: dict[str, str]) -> dict[str, Column]:
    """The least that each rate may truly be: a share over n units is known to
    within ``1 / sqrt(n)``, two standard errors at most, and a mean of n lengths
    to within that part of itself.  Repeated words come in clumps of two windows,
    so n is so many fewer.  So one repeated line of three says little, and the
    document's own size, not a fixed cutoff, says how little."""
    words, lines = (F.when(F.col(names[n]) > 0, F.col(names[n]).cast("double")) for n in ("n_words", "n_lines"))
    found = rates(names)
    less = {"symbol_rate": 1 / F.sqrt(words), "dup_line_rate": 1 / F.sqrt(lines), "repeat_rate": 1 / F.sqrt(words / (2.0 * WINDOW)), "word_length": found["word_length"] / F.sqrt(words)}
    return {r: F.coalesce(v - less[r], F.lit(0.0)) for r, v in found.items()}


def sketch(rows: DataFrame, keys: list[str], values: dict[str, Column], error: float = ERROR) -> DataFrame:
    """Mergeable sketches: keys, metric, bucket (null for 0), n."""
    gamma = math.log((1 + error) / (1 - error))
    each = F.explode(F.create_map(*(x for name, v in values.items() for x in (F.lit(name), v))))
    rows = rows.select(*keys, each.alias("metric", "value"))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / gamma).cast("int"))
    return rows.groupBy(*keys, "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows that the given sketches have seen."""
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy(*(c for c in out.columns if c != "n")).agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], shares: list[float], error: float = ERROR) -> DataFrame:
    """keys, metric, q0, q1, ...: the value whose rank is ceil(share * n); total: n.

    A group has as many rows as buckets, which do not grow with its documents.
    """
    ratio = (1 + error) / (1 - error)
    by = Window.partitionBy(*keys, "metric")
    upto = by.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.select(*keys, "metric", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(by).alias("total"))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(ratio), F.col("bucket")) / (ratio + 1))
    picks = [F.min(F.when(F.col("upto") >= F.ceil(share * F.col("total")), value)).alias(f"q{k}") for k, share in enumerate(shares)]
    return ranked.groupBy(*keys, "metric").agg(*picks, F.max("total").alias("total"))


def group_sketches(counted: DataFrame, names: dict[str, str]) -> DataFrame:
    """Of each language and source, from the counted documents that pass the base rules."""
    rows = counted.where(~base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"])))
    return sketch(rows, ["lang", "source"], rates(names))


def bounds(sketches: DataFrame, keys: list[str], spread: float = SPREAD) -> DataFrame:
    """keys, the bound ``<rate>_most`` of each rate, and the size of the group:
    the upper quartile, plus ``spread`` times the distance between the quartiles."""
    found = quantiles(sketches, keys, [0.25, 0.75])
    bound = F.col("q1") + spread * (F.col("q1") - F.col("q0"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == r, bound)).alias(f"{r}_most") for r in RATES), F.max("total").alias("size"))


def thresholds(sketches: DataFrame, least: int = LEAST_GROUP, spread: float = SPREAD) -> DataFrame:
    """lang, source and, for each rate, its upper bound ``<rate>_most``, from the
    sketches of :func:`group_sketches`, which are merged into those above them.

    A source's bound is at most that of its language, so that junk of over a
    quarter of a source does not set the bound by which it is judged.  A source
    of under ``least`` documents has the bound of its language, a language of
    under ``least`` that of all documents; but a language's word length is its
    own.  Sketches are read several times.  No sketches: no rows.
    """
    sources = bounds(sketches, ["lang", "source"], spread)
    langs = bounds(merge(sketches.drop("source")), ["lang"], spread)
    whole = bounds(merge(sketches.drop("lang", "source")), [], spread).first()  # one row
    langs = langs.select(F.col("lang").alias("_of"), F.struct(*langs.columns).alias("_lang"))
    rows = sources.join(langs, F.col("lang").eqNullSafe(F.col("_of")))

    def bound(rate: str) -> Column:
        most = f"{rate}_most"
        above = F.col(f"_lang.{most}")
        if rate != "word_length":
            above = F.when(F.col("_lang.size") < least, F.lit(whole[most]).cast("double")).otherwise(above)
        return F.when(F.col("size") < least, above).otherwise(F.least(most, above)).alias(most)

    return rows.select("lang", "source", *(bound(r) for r in RATES))


def judge(counted: DataFrame, names: dict[str, str], limits: DataFrame) -> DataFrame:
    """``counted(lang, source, ...)``, with its counts under ``names``, and the
    verdict under ``names["base_failed"]`` and ``names["kept"]``.

    A document is kept if it passes the base rules and no rate is surely over
    the bound of its language and source (null counts as a language and as a
    source).  A group with no document that passes the base rules has no bound.

    Bounds are broadcast if there are at most :data:`BROADCAST_GROUPS` groups,
    which is looked up, else joined by the keys, where Spark splits a language
    and source that many documents share.
    """
    few = limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    group, bound = fresh(counted, "limit_group"), fresh(counted, "limit_bounds")
    rows = limits.select(F.struct("lang", "source").alias(group), F.struct(*(f"{r}_most" for r in RATES)).alias(bound))
    match = F.struct(counted["lang"], counted["source"]).eqNullSafe(rows[group])
    joined = counted.join(F.broadcast(rows) if few else rows, match, "left")
    fine = F.lit(True)
    for rate, value in sure_rates(names).items():
        fine = fine & F.coalesce(value <= F.col(f"{bound}.{rate}_most"), F.lit(True))
    failed = base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"]))
    return joined.withColumns({names["base_failed"]: failed, names["kept"]: ~failed & fine}).drop(group, bound)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of
    ``docs(doc_id, text, lang, source)``.

    Texts are counted once, and the counts, which are small, written out.  Null
    text has no words and fails; null and repeated keys are kept, and repeated
    rows are judged alike; other columns are not looked at; an empty table gives
    an empty one.
    """
    names = {n: n for n in (*COUNTS, "base_failed", "kept")}
    counted = stored(with_counts(docs.select("doc_id", "text", "lang", "source"), names).drop("text"))
    rows = judge(counted, names, stored(thresholds(stored(group_sketches(counted, names)))))
    return rows.select("doc_id", *COUNTS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with their own columns.

    Texts are counted once and written out with their counts.  Nulls, repeated
    rows and empty tables are as in :func:`judged`; columns of any name stay.
    """
    names = {n: fresh(docs, n) for n in (*COUNTS, "base_failed", "kept")}
    counted = stored(with_counts(docs, names))
    rows = judge(counted, names, stored(thresholds(stored(group_sketches(counted, names)))))
    return rows.where(F.col(names["kept"])).select(*docs.columns)
