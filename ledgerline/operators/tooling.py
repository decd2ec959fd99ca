"""Analyses of measurements and of texts: medians, repeated windows, ratchets."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def benchmark_summary(samples: DataFrame, scenario: str, seconds: str, operations: Column, run: str | None = None, warmup: int = 0, counters: tuple[str, ...] = ()) -> DataFrame:
    """Exact median, least and greatest time, and throughput, of each scenario;
    the runs below ``warmup`` by the column ``run`` are left out, and of each of
    the ``counters`` (memory among them) the greatest is kept."""
    if run is not None:
        samples = samples.where(F.col(run) >= warmup)
    more = [F.max(c).alias(c) for c in counters]
    got = samples.groupBy(scenario).agg(F.percentile(seconds, 0.5).alias("median"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.count("*").alias("samples"), F.max(operations).alias("operations"), *more)
    return got.withColumn("throughput", F.col("operations") / F.greatest(F.col("median"), F.lit(1e-9))).drop("operations")


def over_budget(measured: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets(scenario, metric, most, exact)`` that ``measured(scenario, metric,
    value)`` breaks; a scenario that was not measured breaks its budget."""
    met = budgets.join(measured, ["scenario", "metric"], "left")
    broken = F.col("value").isNull() | (F.col("exact") & (F.col("value") != F.col("most"))) | (~F.col("exact") & (F.col("value") > F.col("most")))
    return met.where(broken)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


#: Tokens of source code, the longest first; comments and line ends are tokens, too.
_TOKEN = (
    r"(/\*(?s:.*?)\*/|//[^\n]*|#(?!\[)[^\n]*|'(?:[^'\\]|\\(?s:.))*'|\"(?:[^\"\\]|\\(?s:.))*\"|\$[A-Za-z_]\w*|[A-Za-z_]\w*|\d+(?:\.\d+)?"
    r"|<=>|===|!==|\?\?=|\*\*=|\.\.\.|<<=|>>=|\?->|\?\?|&&|\|\||->|=>|::|\+\+|--|==|!=|<=|>=|<<|>>|\*\*|[-+*/.%&|^]=|\n|[^\s\w])"
)
_COMMENT = r"^(/\*|//|#(?!\[)|\n$)"


def raw_tokens(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(_TOKEN), 1)


def _named(token: Column) -> Column:
    return F.when(token.rlike(r"^\$"), "<variable>").when(token.rlike(r"^['\"\d]"), "<literal>").otherwise(F.lower(token))


def normalized_tokens(source: Column) -> Column:
    """Tokens of source code: comments and white space dropped, variables and
    literals named by kind, the rest in lower case."""
    return F.transform(F.filter(raw_tokens(source), lambda t: ~t.rlike(_COMMENT)), _named)


#: Parts into which the rows of one key are dealt for a join, and documents up to which their marks are broadcast.
_PARTS, _BROADCAST = 16, 1_000_000
_U = np.uint64


def _part(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(5)), F.lit(_PARTS)).cast("int")


def _parts(part: str) -> Column:
    """Aggregate of the parts that a key has, as bits."""
    return F.bit_or(F.expr(f"shiftleft(1, {part})")).alias("bits")


def _each_part() -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(_PARTS - 1)), lambda k: F.getbit("bits", k) == 1)).alias("part")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _anchors(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` hashes the least hash of its runs of half that
    length: equal runs have equal anchors, and neighbours mostly share one."""
    half = (size + 1) // 2
    if len(hashes) < size:
        return np.zeros(0, _U)
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(len(hashes), b, _U) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mixed(hashes) * up)])
    least, span, width = _mixed((sums[half:] - sums[:-half]) * down[: len(hashes) - half + 1]), 1, size - half + 1
    while span < width:
        step = min(span, width - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    return least


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about so many hashes: rows, hashes, and bounds of each row's."""
    for batch in batches:
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False))]).astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = min(batch.num_rows, max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1))
            rows = batch.slice(first, last - first)
            yield rows, rows.column(column).flatten().to_numpy(zero_copy_only=False).view(_U), bounds[first : last + 1] - bounds[first]
            first = last


def _shared_anchors(rows: DataFrame, size: int) -> DataFrame:
    """``rows(id, part, hashes)`` to ``(id, bits, anchors)``: which anchors of its
    windows each id shares with another row, equal ones too."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, hashes, bounds in _slices(batches, "hashes"):
            found = _anchors(hashes, size)
            row = np.repeat(np.arange(held.num_rows), np.diff(bounds))
            inside = np.flatnonzero(row[: len(found)] == row[size - 1 :]) if len(found) else np.zeros(0, np.int64)
            row, found = row[inside], found[inside]
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            of = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([held.column("id").take(of), held.column("part").take(of), pa.array(found[new].view(np.int64))], ["id", "of", "anchor"])

    path = f"{shared_folder(rows.sparkSession)}/anchors-{uuid.uuid4().hex}"
    rows.mapInArrow(mark, "id long, of int, anchor long").withColumn("part", _part("id", "of")).write.parquet(path)
    marks = rows.sparkSession.read.schema("id long, of int, anchor long, part int").parquet(path)
    shared = marks.groupBy("anchor").agg(F.count("*").alias("n"), _parts("part")).where("n > 1").select("anchor", _each_part())
    return marks.join(shared, ["anchor", "part"]).groupBy("id").agg(_parts("of"), F.collect_set("anchor").alias("anchors"))


def duplicate_windows(docs: DataFrame, key: str, words: Column, scope: Column, size: int = 50, samples: int = 3, between: str = "\x01") -> DataFrame:
    """Windows of ``size`` tokens that stand in two documents or more.

    One row each: fingerprint, occurrences, documents (pairs of key and scope),
    scopes (sorted), samples (the first keys).  Null words count for nothing.

    Equal windows have equal anchors, of which a document has one for some
    thirteen windows of 50 tokens.  So anchors move first, and only windows whose
    anchor stands in two rows are fingerprinted and move, once; an anchor shared
    by chance, or by rows of one document, costs time and changes nothing.  A
    token that holds ``between`` counts there as its parts, as it does in the
    joined text that the fingerprint is of; ``between`` is one character.
    """
    if len(between) != 1:
        raise ValueError("between must be one character")
    docs = docs.select(F.col(key).alias("key"), scope.alias("scope"), F.array_compact(words).alias("w")).where(F.size("w") >= size)
    docs = docs.withColumns({"id": F.xxhash64("w"), "part": _part("key", "scope")})
    atoms = F.split(F.array_join("w", between), re.escape(between))
    hashes = F.transform(atoms, lambda t: F.xxhash64(t)).alias("hashes")
    needed = _shared_anchors(docs.select("id", "part", hashes), size)
    path = f"{shared_folder(docs.sparkSession)}/needed-{uuid.uuid4().hex}"
    needed.write.parquet(path)
    needed = docs.sparkSession.read.schema(needed.schema).parquet(path)
    ids = needed.select("id")
    few = ids.limit(_BROADCAST + 1).count() <= _BROADCAST
    held = (docs.join(F.broadcast(ids), "id", "left_semi") if few else docs).join(needed.select("id", "anchors", _each_part()), ["id", "part"])
    end = between.encode()

    def print_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, bounds in _slices(batches, "hashes"):
            found, row, prints, n = _anchors(hashes, size), [], [], []
            for k, (first, past) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                tokens = [t.encode() for t in rows.column("w")[k].as_py()]
                start = np.arange(len(tokens))
                if past - first > len(tokens):
                    start = np.concatenate([[0], np.cumsum([t.count(end) + 1 for t in tokens[:-1]])])
                some = np.isin(found[first + start[: len(tokens) - size + 1]], rows.column("anchors")[k].values.to_numpy().view(_U))
                text, at = end.join(tokens), np.concatenate([[0], np.cumsum([len(t) + len(end) for t in tokens])]).tolist()
                made = Counter(hashlib.sha256(text[at[i] : at[i + size] - len(end)]).digest() for i in np.flatnonzero(some).tolist())
                row += [k] * len(made)
                prints += made.keys()
                n += made.values()
                if len(row) >= 1 << 16 or k == rows.num_rows - 1:
                    of = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), rows.column("key").take(of), rows.column("scope").take(of), pa.array(n, pa.int64())], ["fingerprint", "key", "scope", "n"])
                    row, prints, n = [], [], []

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("key", "scope"))
    # one shuffle: what follows groups by the fingerprint and more
    made = held.select("key", "scope", "w", "anchors", hashes).mapInArrow(print_windows, f"fingerprint binary, {kinds}, n long").repartition("fingerprint")
    each = made.groupBy("fingerprint", "key", "scope").agg(F.sum("n").alias("n"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.col("key").asc_nulls_last())))
    firsts, scopes = F.collect_list(F.when(F.col("r") <= samples, F.col("key"))), F.collect_set("scope")
    found = each.groupBy("fingerprint").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"), scopes.alias("scopes"), firsts.alias("samples")).where("documents >= 2")
    scopes = F.when(F.size("scopes") > 0, F.array_join(F.array_sort("scopes"), ","))
    firsts = F.array_join(F.transform(F.array_sort("samples"), lambda k: k.cast("string")), ",")
    return found.select(F.lower(F.hex("fingerprint")).alias("fingerprint"), "occurrences", "documents", scopes.alias("scopes"), firsts.alias("samples"))


#: Keywords that branch, that nest, and operators of conditions.
BRANCHES = ("if", "elseif", "for", "foreach", "while", "case", "catch")
CONTROLS = ("if", "elseif", "for", "foreach", "while", "do", "switch", "catch")
BOOLEANS = ("&&", "||", "and", "or", "xor", "??")


def token_rows(files: DataFrame, key: str, tokens: str) -> DataFrame:
    """``files(key, tokens)`` to a row per token: key, at, t, and for braces level,
    the depth that an opening one begins and its closing one ends."""
    rows = files.select(F.col(key).alias("key"), F.posexplode(tokens).alias("at", "t"))
    step = F.when(F.col("t") == "{", 1).when(F.col("t") == "}", -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("key").orderBy("at"))
    return rows.withColumn("level", F.when(F.col("t") == "{", depth).when(F.col("t") == "}", depth + 1))


def code_metrics(bodies: DataFrame, key: str = "key", tokens: str = "tokens", name: str | None = None) -> DataFrame:
    """key, cyclomatic, cognitive and nesting of each body of normalised tokens.

    cyclomatic: one, and one for each branch, operator of conditions and
    ternary.  nesting: the most control structures that are open at once; a
    brace is one's if a control word stands between it and the brace before.
    cognitive: one for each control word, with the nesting there except for
    elseif, for each else, for each operator of conditions that does not follow
    the same one but for parentheses and negation, and for each call of the body's own ``name``.
    A body is a partition; bodies without tokens have the metrics 1, 0, 0.
    """
    by = Window.partitionBy("key").orderBy("at")
    past, t = by.rowsBetween(Window.unboundedPreceding, -1), F.col("t")
    own = F.lower(F.col(name)) if name else F.lit(None).cast("string")
    known = bodies.select(F.col(key).alias("key"), own.alias("own"), F.col(tokens).alias("tokens"))
    rows = token_rows(known, "key", "tokens")
    rows = rows.withColumn("word", F.when(t.isin(*CONTROLS) | (t == "else"), F.col("at"))).withColumn("brace", F.when(t == "{", F.col("at")))
    last_word, last_brace = F.last("word", ignorenulls=True).over(past), F.last("brace", ignorenulls=True).over(past)
    rows = rows.withColumn("opens", (t == "{") & F.coalesce(last_word > F.coalesce(last_brace, F.lit(-1)), F.lit(False)))
    pair = Window.partitionBy("key", "level").orderBy("at")
    rows = rows.withColumn("ends", (t == "}") & F.coalesce(F.lag("opens").over(pair) & (F.lag("t").over(pair) == "{"), F.lit(False)) & F.col("level").isNotNull())
    rows = rows.withColumn("nesting", F.sum(F.col("opens").cast("int") - F.col("ends").cast("int")).over(by))
    before = F.last(F.when(~t.isin("(", ")", "!"), t), ignorenulls=True).over(past)
    rows = rows.withColumns({"before": before, "next": F.lead("t").over(by)}).join(known.select("key", "own"), "key")
    control = F.when(t.isin(*CONTROLS), 1 + F.when(t == "elseif", 0).otherwise(F.col("nesting"))).when(t == "else", 1).otherwise(0)
    boolean = (t.isin(*BOOLEANS) & ~t.eqNullSafe(F.col("before"))).cast("int")
    recursive = F.coalesce((t == F.col("own")) & (F.col("next") == "("), F.lit(False)).cast("int")
    found = rows.groupBy("key").agg(F.count_if(t.isin(*BRANCHES, *BOOLEANS, "?")).alias("b"), F.sum(control + boolean + recursive).alias("c"), F.max("nesting").alias("n"))
    out = known.select("key").join(found, "key", "left")
    return out.select(F.col("key").alias(key), (1 + F.coalesce("b", F.lit(0))).alias("cyclomatic"), F.coalesce("c", F.lit(0)).alias("cognitive"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("nesting"))


def source_files(spark: SparkSession, folder: str, suffix: str = "php") -> DataFrame:
    """``(path, text)`` of the source files under ``folder``, whole."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def inventory(files: DataFrame) -> DataFrame:
    """Classes and methods of ``files(path, text)``: path, kind, class, method,
    first_line, lines and, of methods, the normalised tokens of the body.

    A declaration goes to the brace that closes its body; one without a body is
    left out, as are functions without a name.  A method is the innermost
    class's around it.  A file is a partition.
    """
    raw = files.select("path", F.posexplode(raw_tokens(F.col("text"))).alias("n", "t"))
    lines = F.length("t") - F.length(F.replace(F.col("t"), F.lit("\n")))
    line = 1 + F.coalesce(F.sum(lines).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = raw.withColumn("line", line).where(~F.col("t").rlike(_COMMENT)).withColumn("raw", F.col("t")).withColumn("t", _named(F.col("t")))
    kept = kept.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1)
    by = Window.partitionBy("path").orderBy("at")
    step = F.when(F.col("t") == "{", 1).when(F.col("t") == "}", -1).otherwise(0)
    kept = kept.withColumn("depth", F.sum(step).over(by)).withColumn("level", F.when(F.col("t") == "{", F.col("depth")).when(F.col("t") == "}", F.col("depth") + 1))
    braces = kept.where("level IS NOT NULL")
    pair = Window.partitionBy("path", "level").orderBy("at")
    braces = braces.select("path", "t", F.col("at").alias("open"), F.lead("at").over(pair).alias("close"), F.lead("line").over(pair).alias("last_line")).where("t = '{' AND close IS NOT NULL").drop("t")
    ahead = by.rowsBetween(1, Window.unboundedFollowing)
    heads = kept.withColumns({
        "name": F.lead("raw").over(by), "prior": F.lag("t").over(by),
        "open": F.first(F.when(F.col("t") == "{", F.col("at")), ignorenulls=True).over(ahead), "stop": F.first(F.when(F.col("t") == ";", F.col("at")), ignorenulls=True).over(ahead),
    })
    heads = heads.where(F.col("t").isin("class", "interface", "trait", "enum", "function") & F.col("name").rlike("^[A-Za-z_]") & ~F.coalesce(F.col("prior").isin("::", "->", "new"), F.lit(False)) & (F.col("open") < F.coalesce("stop", F.lit(2**31 - 1))))
    found = heads.select("path", F.when(F.col("t") == "function", "method").otherwise("class").alias("kind"), "name", "at", F.col("line").alias("first_line"), "open").join(braces, ["path", "open"])
    around = found.where("kind = 'class'").select("path", F.col("name").alias("class"), F.col("open").alias("from"), F.col("close").alias("to"))
    methods = found.where("kind = 'method'").join(around, "path").where("from < at AND close < to")
    methods = methods.groupBy("path", "at", "name", "first_line", "last_line", "open", "close").agg(F.max(F.struct("from", "class"))["class"].alias("class"))
    body = kept.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x.t).alias("all"))
    methods = methods.join(body, "path").withColumn("tokens", F.expr("slice(all, open + 2, close - open - 1)"))
    size = (F.col("last_line") - F.col("first_line") + 1).alias("lines")
    of_class = found.where("kind = 'class'").select("path", "kind", F.col("name").alias("class"), F.lit(None).cast("string").alias("method"), "first_line", size, F.lit(None).cast("array<string>").alias("tokens"))
    return of_class.unionByName(methods.select("path", F.lit("method").alias("kind"), "class", F.col("name").alias("method"), "first_line", size, "tokens"))


def top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def ratchet(current: DataFrame, baseline: DataFrame, targets: dict[str, int], exceptions: DataFrame | None = None) -> DataFrame:
    """Metrics over their limit: ``current(key, metric, value)`` against
    ``baseline(key, metric, value)``, or the metric's target where that has none.

    ``exceptions(key, metric, reason)`` with a reason that is not blank allow a
    metric, or all with ``*``.  Columns: key, metric, old, new, allowed.
    """
    target = F.coalesce(*[F.when(F.col("metric") == m, F.lit(t)) for m, t in targets.items()], F.lit(0))
    met = current.withColumnRenamed("value", "new").join(baseline.withColumnRenamed("value", "old"), ["key", "metric"], "left").withColumn("old", F.coalesce("old", target))
    worse = met.where("new > old")
    if exceptions is None:
        return worse.select("key", "metric", "old", "new", F.lit(None).cast("string").alias("allowed"))
    good = exceptions.where(F.length(F.trim("reason")) > 0)
    exact = good.where("metric <> '*'").groupBy("key", "metric").agg(F.min("reason").alias("_one"))
    every = good.where("metric = '*'").groupBy("key").agg(F.min("reason").alias("_all"))
    return worse.join(exact, ["key", "metric"], "left").join(every, "key", "left").select("key", "metric", "old", "new", F.coalesce("_one", "_all").alias("allowed"))


def coverage_met(covered: Column, statements: Column, least: float) -> Column:
    return F.coalesce(covered * 100.0 / F.when(statements > 0, statements), F.lit(0.0)) >= least


def event_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count("*").alias("n"), F.min("duration_ms").alias("least"), F.max("duration_ms").alias("most"), F.percentile("duration_ms", 0.5).alias("median"))


#: States of a job in the log's fold.
FOLD_STATES = ("none", "pending", "running", "completed", "failed")


def ledger_fold(log: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """The last status of each job from ``log(seq, ts, job_id, op)``.

    Operations act in order of (ts, seq).  Those of a slice of time are folded
    into a function, the end of each state it may begin in, and a job's
    functions are then composed in order: so a job with very many operations is
    spread over its slices, and what comes together for it is a row per slice.
    """
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (slice_seconds * 1_000_000))
    ops = log.groupBy("job_id", at.alias("slice")).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "op"))).alias("ops"))
    next_state = lambda s, o: (
        F.when((o.op == "create") & s.isin("none", "completed", "failed"), "pending").when((o.op == "claim") & (s == "pending"), "running")
        .when((o.op == "complete") & (s == "running"), "completed").when((o.op == "fail") & (s == "running"), "failed").otherwise(s)
    )
    begin = F.array(*map(F.lit, FOLD_STATES))
    ends = F.aggregate("ops", begin, lambda states, o: F.transform(states, lambda s: next_state(s, o)))
    folded = ops.select("job_id", "slice", F.map_from_arrays(begin, ends).alias("ends"), F.size("ops").cast("long").alias("n"))
    parts = folded.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("slice", F.map_entries("ends").alias("ends")))).alias("parts"), F.sum("n").alias("n_ops"))
    status = F.aggregate("parts", F.lit("none"), lambda s, part: F.element_at(F.map_from_entries(part.ends), s))
    return parts.select("job_id", status.alias("status"), "n_ops")
