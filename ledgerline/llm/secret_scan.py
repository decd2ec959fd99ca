"""Secret scans: fixed patterns, and guess costs of values in credential context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import U64, _power_tables, runs, splitmix
from .shared import stored

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "guess")

# The patterns of the base scan.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
#: A run that is too short holds no match of the full length, so these two find
#: what the base patterns find and keep.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Where a value may be a credential: after such a word and a sign, or "is"; up
#: to its closing quote on the same line, or up to white space and such.
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|(?:access|private|auth)[_-]?key|auth|login|pin)["']?(?:\x20*(?:[:=]|=>)\x20*|\x20is:?\x20)(?:"([^"\n]+)"(?!\w)|'([^'\n]+)'(?!\w)|["']?([^\s"'<>,;]+))""", re.ASCII | re.IGNORECASE
)

#: Frequent words of passwords and of texts, most frequent first; those of a
#: corpus come from :func:`frequent_words`.
WORDS = (
    "password the and love admin welcome monkey dragon master login hello letmein princess sunshine football baseball shadow superman "
    "secret summer winter spring autumn test user root guest access default change changeme please system server data base house home "
    "money happy family friend angel baby girl boy king queen star blue red green black white silver gold hunter ranger soccer hockey "
    "computer internet network service account token private public office company market school music guitar flower orange apple "
    "banana cherry pepper ginger cookie coffee chocolate tiger lion eagle wolf bear horse cat dog bird fish river mountain ocean island "
    "garden forest street city london paris berlin michael jennifer thomas jordan daniel andrew charlie robert matthew jessica "
    "ashley nicole maria anna peter george one two three four five six seven eight nine ten for with from this that have not you are was"
).split()
#: A corpus's words: so many at most, each in so many texts at least, no longer than this.
MOST_WORDS, LEAST_TEXTS, LONGEST_WORD = 100_000, 5, 32
_LETTERS = re.compile(r"[^\W\d_]{3,}")
#: Words beyond which a task hands on its counts.
HELD_WORDS = 50_000


class Ranks(dict):
    """The rank of each word: its best in :data:`WORDS` and in ``more``."""

    def __init__(self, more: Iterable[str] = ()):
        super().__init__({w: k + 1 for k, w in enumerate(dict.fromkeys(WORDS))})
        for k, word in enumerate(more):
            self[word] = min(self.get(word, k + 1), k + 1)
        self.longest = max(map(len, self))


_RANK = Ranks()
_PLAIN = str.maketrans("@4031!57$", "aaoeiists")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFT = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")


def _neighbours() -> dict[str, set[str]]:
    at = {c: (x + 0.5 * y * (y > 0), y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
    return {a: {b for b, (u, v) in at.items() if a != b and abs(u - x) <= 1 and abs(v - y) <= 1} for a, (x, y) in at.items()}


_NEAR = _neighbours()
_DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\3(?:19|20)\d\d|(?:19|20)\d\d))")
_THIS_YEAR = 2000  # dates near it are guessed first; a constant keeps costs the same over time
#: log10 of the guesses for one more segment.
SEGMENT = 1.0
#: Characters up to which repeats are looked for period by period; in longer
#: values the same repeats are found by hashes.
PLAIN_LENGTH = 192


def _sets(value: str) -> float:
    """log10 of the number of characters of the classes that occur."""
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value)
    size += 33 * any(not c.isalnum() and c.isascii() for c in value) + 100 * any(not c.isascii() for c in value)
    return math.log10(max(size, 10))


def _word_spans(value: str, lower: str, ranks: Ranks) -> Iterator[tuple[int, int, float]]:
    plain = lower.translate(_PLAIN)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + ranks.longest) + 1):
            rank = ranks.get(plain[i:j])
            if rank:
                changed = sum(a != b for a, b in zip(plain[i:j], lower[i:j], strict=True))
                upper = sum(c.isupper() for c in value[i:j])
                bits = changed + (0 if not upper else 1 if upper == j - i or upper == 1 and value[i].isupper() else upper)
                yield i, j, math.log10(rank) + bits * math.log10(2)


def _date_spans(value: str) -> Iterator[tuple[int, int, float]]:
    for m in _DATE.finditer(value):
        year = int(re.search(r"(?:19|20)\d\d", m[1])[0])
        years = max(20, abs(year - _THIS_YEAR))
        yield m.start(1), m.end(1), math.log10(years * (365 if len(m[1]) > 4 else 1) * (4 if m[2] or m[3] else 1))


def _repeat_spans(value: str, one: float) -> Iterator[tuple[int, int, float]]:
    """Runs of any period, as far as they go: two units or more, of three
    characters or more in all."""
    n = len(value)
    for first, end, period in _plain_runs(value) if n <= PLAIN_LENGTH else _hashed_runs(value):
        yield first, end, period * one + math.log10((end - first - period) // period + 1)


def _plain_runs(value: str) -> Iterator[tuple[int, int, int]]:
    n = len(value)
    for period in range(1, n // 2 + 1):
        run = 0
        for i in range(period, n + 1):
            if i < n and value[i] == value[i - period]:
                run += 1
                continue
            if run >= max(period, 2):
                yield i - run - period, i, period
            run = 0


def _hashed_runs(value: str, pairs: int = 1 << 20) -> Iterator[tuple[int, int, int]]:
    """The same runs.  One of period p has two places in a row that are multiples
    of p, and the value agrees with itself around them for p characters or more:
    so there are n log n places to look at, in parts of so many ``pairs``.  Hashes
    of eight characters tell nearly all that do not agree, and bisection on
    hashes how far the others do.  Periods up to 16 are compared directly."""
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(splitmix(points + U64(1)) * up[:n], out=sums[1:])

    def same(x: np.ndarray, y: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (sums[x + size] - sums[x]) * down[x] == (sums[y + size] - sums[y]) * down[y]

    def reach(a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            equal = same(a - half, b - half, half) if back else same(a, b, half)
            low, high = np.where(equal, half, low), np.where(equal, high, half - 1)
        return low

    for period in range(1, min(16, n // 2) + 1):
        first, end = runs(points[period:] == points[:-period], np.array([0, n - period]))
        some = end - first >= max(period, 2)
        yield from zip(first[some].tolist(), (end[some] + period).tolist(), [period] * int(some.sum()), strict=True)
    places = np.maximum(0, (n - 1) // np.maximum(1, np.arange(n // 2 + 1)))  # pairs of multiples of each period
    places[:17] = 0
    before = np.concatenate([[0], np.cumsum(places)])
    period = 17
    while period <= n // 2:
        until = max(period + 1, int(np.searchsorted(before, before[period] + pairs, "right")) - 1)
        until = min(until, n // 2 + 1)
        some = np.repeat(np.arange(period, until), places[period:until])
        a = some * (np.arange(len(some)) - np.repeat(before[period:until] - before[period], places[period:until]))
        b, period = a + some, until
        ahead, behind = b + 8 <= n, a >= 8
        ahead[ahead] = same(a[ahead], b[ahead], 8)
        behind[behind] = same(a[behind] - 8, b[behind] - 8, 8)
        a, b, some = (x[ahead | behind] for x in (a, b, some))
        ahead, behind = reach(a, b, n - b, False), reach(a, b, a, True)
        keep = (ahead + behind >= some) & (behind < some)  # from the first two multiples in the run
        yield from zip((a - behind)[keep].tolist(), (b + ahead)[keep].tolist(), some[keep].tolist(), strict=True)


def _walk_spans(lower: str) -> Iterator[tuple[int, int, float]]:
    keys, first, turns, last = lower.translate(_SHIFT), 0, 0, None
    for i in range(1, len(keys) + 1):
        step = None
        if i < len(keys) and keys[i] in _NEAR.get(keys[i - 1], ()):
            step = next(((y, _ROWS[y].index(keys[i])) for y in range(4) if keys[i] in _ROWS[y]), None)
            before = next(((y, _ROWS[y].index(keys[i - 1])) for y in range(4) if keys[i - 1] in _ROWS[y]), None)
            step = (step[0] - before[0], step[1] - before[1])
        if step is None:
            if i - first >= 4:
                yield first, i, math.log10(47 * (i - first)) + (turns + 1) * math.log10(5)
            first, turns, last = i, 0, None
        elif step != last:
            turns, last = turns + (last is not None), step


def guess_cost(value: str, ranks: Ranks = _RANK) -> float:
    """log10 of the guesses that find ``value``: the cheapest segmentation into
    words, dates, repeats, keyboard walks and brute-force spans.

    ``best[i]`` is the least cost of the first i characters; ``brute[i]`` the
    least of those whose last segment is brute force, to which one more
    character adds the same cost.  Each segment costs :data:`SEGMENT` besides.
    Time grows with the length times the longest word, and for repeats with
    n log(n) squared; any length is taken.
    """
    n = len(value)
    if not n:
        return 0.0
    one, lower = _sets(value), value.lower() if len(value.lower()) == n else value
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for spans in (_word_spans(value, lower, ranks), _date_spans(value), _repeat_spans(value, one), _walk_spans(lower)):
        for i, j, cost in spans:
            ending[j].append((i, cost))
    best, brute = 0.0, math.inf
    bests = [0.0]
    for j in range(1, n + 1):
        brute = min(best + SEGMENT, brute) + one
        best = min([brute, *(bests[i] + SEGMENT + cost for i, cost in ending[j])])
        bests.append(best)
    return best


def scan(text: str, least_cost: float = 13.0, least_length: int = 8, ranks: Ranks = _RANK) -> list[tuple[int, str, int]]:
    """Spans ``(start, kind, end)`` of a text, in code points, sorted by start
    and then by the order of :data:`KINDS`.

    assign, access, hex: the base patterns, leftmost and non-overlapping for
    each kind, those too short dropped.  guess: a value in credential context,
    of ``least_length`` characters or more, whose guess cost is ``least_cost``
    (log10) or more.
    """
    spans = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    spans += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    for m in _CONTEXT.finditer(text):
        k = m.lastindex
        value = m[k] if k < 3 else m[k].rstrip(".:)]}!?")
        if len(value) >= least_length and guess_cost(value, ranks) >= least_cost:
            spans.append((m.start(k), "guess", m.start(k) + len(value)))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def frequent_words(docs: DataFrame, text: str = "text", most: int = MOST_WORDS, least: int = LEAST_TEXTS) -> list[str]:
    """The words, in lower case, that most texts of ``docs`` hold, most frequent
    first: at most ``most``, each in ``least`` rows or more.  Words that as many
    texts hold come together or not at all.

    A word is a run of letters, counted once a row, and not where it is a value
    in credential context.  All rows are counted; a task holds
    the counts of some 50,000 words at a time.  A running sum over the counts
    that occur, one row each, tells which are frequent enough, so the driver is
    sent no more than the words that it returns.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for k, x in enumerate(batch.column(0), 1):
                found.update({w for w in _LETTERS.findall(_CONTEXT.sub(" ", x.as_py() or "").lower()) if len(w) <= LONGEST_WORD})
                if len(found) > HELD_WORDS or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
                    found = Counter()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted.where(F.col("n") >= least))
    upto = counted.groupBy("n").agg(F.count("*").alias("words")).select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("upto"))
    cut = upto.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    found = counted.where(F.col("n") >= cut).collect() if cut else []
    return [r.word for r in sorted(found, key=lambda r: (-r.n, r.word))]


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", least_cost: float = 13.0, least_length: int = 8) -> DataFrame:
    """``(key, spans)`` of every row; null text has no spans, null and repeated
    keys are kept, other columns are not looked at, an empty table gives an
    empty one.  Guesses know the words that are frequent in all of ``docs``."""
    ranks = Ranks(frequent_words(docs, text))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in scan(x.as_py() or "", least_cost, least_length, ranks)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, _ARROW)], ["key", "spans"])

    return rows.mapInArrow(find, f"key {rows.schema['key'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("key", key)


def _of(kind: str):
    return lambda s: s.kind == kind


def digest_spans(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as one string), a
    row for each row of ``scanned``; no spans give 0 and empty strings."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "guess")
    counts = [F.size(F.filter("spans", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(text: str, mask: str = "[SECRET]", **options) -> str:
    """``text`` with a mask for each span; spans that overlap share one."""
    spans = scan(text, **options)
    if not spans:
        return text
    out, at, mark = [], 0, -1
    for start, _, end in spans:
        if start >= mark:
            out += [text[at:start], mask]
            at = mark = end
        elif end > mark:
            at = mark = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``length`` (if there is such
    a column) set to the new number of characters where the text changed.  Null
    text stays null, repeated rows stay, columns of any name stay, an empty
    table gives an empty one.  Guesses know the words that are frequent in all
    of ``docs``."""
    ranks = Ranks(frequent_words(docs, text))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            old = batch.column(at).to_pylist()
            new = [x and redact(x, ranks=ranks, **options) for x in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length in batch.schema.names:
                k = batch.schema.get_field_index(length)
                columns[k] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, columns[k].to_pylist(), strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)
