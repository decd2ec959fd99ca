"""Language of words and texts by a linear-chain conditional random field.

A word's emission scores are the mean weights of its affixes and n-grams (of
``^word$``, so that those at its ends are told apart) plus the weight of its
entry in a learned lexicon.  Transitions are learned from
sequences in which passages of several languages follow one another, so that
they hold for code-switched text.  Forward-backward gives each word's
probabilities, and their mean, by letters, is the text's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import U64, runs, slices, span_hashes, splitmix, text_bytes

#: Lengths of n-grams, and bits of the table of weights of each length.
GRAMS, BITS = (2, 3, 4), 15
#: Letters of the prefixes, and of the suffixes; a shorter word is its own.
AFFIXES = (2, 3, 4)
#: Tables of weights: one for each length of n-grams, for prefixes and for suffixes.
TABLES = len(GRAMS) + 2
#: A longer text goes into the sample as so many slices of so many characters.
SLICES, SLICE = 12, 500
UNKNOWN = "und"
#: Labels up to which the budgets of texts and words hold; they shrink beyond.
FULL_BUDGET = 32


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                lower[c] = ord(y)
    return letter, lower


@dataclass
class Words:
    """The words of many texts: hashes, lengths, the rows' first words, for each
    length of n-grams their table places, word by word, and each word's first,
    and the places of each word's affixes."""

    hashes: np.ndarray
    letters: np.ndarray
    first: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]] = field(repr=False)
    affixes: np.ndarray = field(repr=False)

    def counts(self) -> np.ndarray:
        """Features of each word."""
        return sum(np.diff(first) for _, first in self.grams) + self.affixes.shape[1]


def word_features(data: np.ndarray, offsets: np.ndarray) -> Words:
    letter, lower = _letters()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    starts, ends = runs(letter[points], at)
    first = np.searchsorted(starts, at)
    size = ends - starts
    n = int(size.sum()) + 2 * len(size)
    word_at = np.cumsum(size + 2) - (size + 2)
    padded = np.full(n, ord("^"), np.uint64)
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.ones(n, bool)
    inner[word_at] = False
    inner[word_at + size + 1] = False
    padded[word_at + size + 1] = ord("$")
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    padded[inner] = lower[points[inside]]
    begin, end = word_at + 1, word_at + 1 + size
    short = [np.minimum(size, k) for k in AFFIXES]
    spans = span_hashes(padded, np.concatenate([word_at, *([begin] * len(AFFIXES)), *(end - k for k in short)]), np.concatenate([word_at + size + 2, *(begin + k for k in short), *([end] * len(AFFIXES))]))
    hashes, ends = spans[: len(size)], spans[len(size) :].reshape(2 * len(AFFIXES), len(size)).T
    affixes = (ends >> U64(64 - BITS)).astype(np.int32) + (len(GRAMS) + np.repeat([0, 1], len(AFFIXES)).astype(np.int32) << BITS)
    left = np.repeat(size + 2, size + 2) - (np.arange(n) - np.repeat(word_at, size + 2))
    grams = []
    for k, gram in enumerate(GRAMS):
        total = padded.copy()
        for j in range(1, gram):
            total[: n - j] = total[: n - j] * U64(0x9E3779B97F4A7C15) + padded[j:]
        place = (splitmix(total[left >= gram]) >> U64(64 - BITS)).astype(np.int32) + (k << BITS)
        grams.append((place, np.concatenate([[0], np.cumsum(np.maximum(0, size + 3 - gram))])))
    return Words(hashes, size, first, grams, affixes)


@dataclass
class Model:
    """Weights: grams (tables of n-grams and affixes x labels), lexicon (entries x labels, by sorted
    hash), transitions and starts."""

    labels: list[str]
    grams: np.ndarray
    lexicon_hashes: np.ndarray
    lexicon: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray
    scale: float = 6.0

    def entries(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words have an entry, and which."""
        if not len(self.lexicon_hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon_hashes, hashes), len(self.lexicon_hashes) - 1)
        has = np.flatnonzero(self.lexicon_hashes[at] == hashes)
        return has, at[has]

    def emissions(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.hashes), len(self.labels)), np.float32)
        for k in range(len(self.labels)):
            weights = np.ascontiguousarray(self.grams[:, k])
            for place, first in words.grams:
                sums = np.zeros(len(place) + 1)
                np.cumsum(weights[place], out=sums[1:])
                out[:, k] += np.diff(sums[first])
            for affix in words.affixes.T:
                out[:, k] += weights[affix]
        out *= (self.scale / words.counts())[:, None].astype(np.float32)
        has, entry = self.entries(words.hashes)
        out[has] += self.lexicon[entry]
        return out


def _time_major(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains of these lengths (descending): for each step the number of
    chains that reach it, where the step's elements begin, and the place of
    every element, given chain by chain, in an order step by step."""
    steps = int(length[0]) if len(length) else 0
    active = len(length) - np.searchsorted(length[::-1], np.arange(steps), "right")
    begin = np.concatenate([[0], np.cumsum(active)])
    chain = np.repeat(np.arange(len(length)), length)
    step = np.arange(len(chain)) - np.repeat(np.cumsum(length) - length, length)
    return active, begin, begin[step] + chain


def marginals(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Forward-backward over the chains ``first[k]:first[k + 1]``: each word's
    probabilities of the labels."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    active, begin, place = _time_major(length[length > 0])
    source = np.repeat(first[:-1][order], length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    e = np.empty(emissions.shape, np.float64)
    e[place] = emissions[source]
    e = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
    a, forward = np.exp(transitions), np.empty_like(e)
    now = np.exp(starts)[None, :]
    for n, b in zip(active.tolist(), begin.tolist(), strict=False):
        now = (now[:n] @ a if b else now) * e[b : b + n]
        now /= now.sum(axis=1, keepdims=True)
        forward[b : b + n] = now
    back = np.ones((0, e.shape[1]))
    for n, b in zip(active[::-1].tolist(), begin[:-1][::-1].tolist(), strict=True):
        if len(back) < n:
            back = np.concatenate([back, np.ones((n - len(back), e.shape[1]))])
        forward[b : b + n] *= back
        back = (back * e[b : b + n]) @ a.T
        back /= back.sum(axis=1, keepdims=True)
    out = np.empty_like(forward)
    out[source] = forward[place]
    return out / out.sum(axis=1, keepdims=True) if len(out) else out


def train(texts: list[str], langs: list[str], rounds: int = 30, length: int = 48, entries: int = 4000, most_words: int = 240_000, seed: int = 7) -> Model:
    """A field learned from whole labelled texts; every word of a text has the
    text's label.

    Sequences of ``length`` words hold one to three passages of texts drawn by
    a fixed seed; at most ``most_words`` words in all, spread over the
    labels alike.  Beyond :data:`FULL_BUDGET` labels the words become fewer, so
    that words times labels stay, but for four sequences a label, and passages
    go round the labels.  The lexicon is the ``entries`` most frequent words.
    """
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((TABLES << BITS, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    k, number = len(labels), {x: n for n, x in enumerate(labels)}
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    words = word_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    by_label = [[d for d in range(len(texts)) if number[langs[d]] == y and words.first[d + 1] > words.first[d]] for y in range(k)]
    usable = [y for y in range(k) if by_label[y]]
    random = np.random.default_rng(seed)
    ids, gold, turn = [], [], 0
    most_words = most_words if k <= FULL_BUDGET else max(most_words * FULL_BUDGET // k, 4 * length * k)
    for _ in range(min(most_words, max(2 * len(words.hashes), 20 * length, 0 if k <= FULL_BUDGET else 4 * length * k)) // length if usable else 0):
        passages = int(random.integers(1, 4)) if random.random() < 0.7 else 1
        cuts = np.sort(random.choice(np.arange(1, length), passages - 1, replace=False))
        for n in np.diff([0, *cuts, length]):
            y = usable[random.integers(len(usable)) if k <= FULL_BUDGET else turn % len(usable)]
            turn += 1
            d = by_label[y][random.integers(len(by_label[y]))]
            a, b = words.first[d], words.first[d + 1]
            ids.append(a + (random.integers(b - a) + np.arange(n)) % (b - a))
            gold.append(np.full(n, y))
    model = Model(labels, np.zeros((TABLES << BITS, k), np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32), np.eye(k), np.zeros(k))
    if not ids:
        return model
    ids, gold = np.concatenate(ids), np.concatenate(gold)
    used, which = np.unique(ids, return_inverse=True)
    kinds, kind_at, kind_of = np.unique(words.hashes[used], return_index=True, return_inverse=True)
    which = kind_of[which]  # the kind of each position
    counts = np.bincount(which)
    top = np.sort(np.argsort(-counts, kind="stable")[:entries])
    model.lexicon_hashes, model.lexicon = kinds[top], np.zeros((len(top), k), np.float32)
    at = used[kind_at]
    grams = []
    for place, first in words.grams:
        size = np.diff(first)[at]
        spread = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1][at], size)
        grams.append((place[spread], np.concatenate([[0], np.cumsum(size)])))
    kind_words = Words(kinds, words.letters[at], np.array([0, len(kinds)]), grams, words.affixes[at])
    count = kind_words.counts()
    target = np.zeros((len(gold), k))
    target[np.arange(len(gold)), gold] = 1
    chains, steps = len(gold) // length, length
    first = np.arange(0, len(gold) + 1, length)
    pairs = np.bincount(gold.reshape(chains, steps)[:, :-1].ravel() * k + gold.reshape(chains, steps)[:, 1:].ravel(), minlength=k * k).reshape(k, k)
    state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for turn in range(1, rounds + 1):
        e = model.emissions(kind_words)[which]
        p = marginals(e, first, model.transitions, model.starts)
        wrong = target - p
        per_kind = np.stack([np.bincount(which, wrong[:, y], len(kinds)) for y in range(k)], axis=1)
        shares = per_kind * (model.scale / count)[:, None]
        grams = np.zeros(model.grams.shape)
        for place, begin in kind_words.grams:
            flat = np.repeat(np.arange(len(kinds)), np.diff(begin))
            grams += np.stack([np.bincount(place, shares[flat, y], len(model.grams)) for y in range(k)], axis=1)
        for affix in kind_words.affixes.T:
            grams += np.stack([np.bincount(affix, shares[:, y], len(model.grams)) for y in range(k)], axis=1)
        gradient = {"grams": grams, "lexicon": per_kind[top], "transitions": pairs - _expected_pairs(e, p, chains, steps, model), "starts": wrong.reshape(chains, steps, k)[:, 0].sum(0)}
        for name, g in gradient.items():  # Adam, upwards, with a small decay
            value = getattr(model, name)
            g = g / chains - 1e-4 * value
            m, v = state.get(name, (0, 0))
            m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
            state[name] = (m, v)
            setattr(model, name, (value + 0.15 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.98**turn)) + 1e-8)).astype(value.dtype))
    return model


def _expected_pairs(e: np.ndarray, p: np.ndarray, chains: int, steps: int, model: Model) -> np.ndarray:
    """Expected numbers of each pair of neighbouring labels."""
    k = len(model.labels)
    x = np.exp(e - e.max(axis=1, keepdims=True)).reshape(chains, steps, k).astype(np.float64)
    a = np.exp(model.transitions)
    forward = np.empty((steps, chains, k))
    now = np.exp(model.starts)[None, :] * x[:, 0]
    forward[0] = now / now.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (forward[t - 1] @ a) * x[:, t]
        forward[t] = now / now.sum(1, keepdims=True)
    total, q = np.zeros((k, k)), p.reshape(chains, steps, k)
    for t in range(1, steps):
        # given the label at t, that at t - 1 depends on the past alone
        ahead = forward[t - 1] @ a
        total += a * (forward[t - 1].T @ (q[:, t] / np.maximum(ahead, 1e-300)))
    return total


# -- columns ---------------------------------------------------------------


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0))


def passages(text: str, slices: int = SLICES, size: int = SLICE) -> str:
    """A text of at most ``slices * size`` characters as it is; of a longer one
    so many slices, begun at places that its checksum draws, without the words
    that they cut."""
    if len(text) <= slices * size:
        return text
    random = np.random.default_rng(zlib.crc32(text.encode()))
    cut = (text[k : k + size] for k in sorted(random.integers(0, len(text) - size, slices).tolist()))
    return "\n".join(x.partition(" ")[2].rpartition(" ")[0] or x for x in cut)


def fit(docs: DataFrame, per_label: int = 150, fold: int | None = 1) -> Model:
    """A field from ``docs(doc_id, text, lang)``.

    Learned from a bounded sample of every language: at most ``per_label`` texts
    of each, those with the least hash of the text, copies once; of more than
    :data:`FULL_BUDGET` languages so many fewer each, but 8.  Of a long text the
    sample has :func:`passages`, cut before anything moves, so the driver holds
    at most 6,000 characters for each of these texts, however long they are.
    Documents of the ``fold`` (crc32 of doc_id mod 3), of null language or null
    text are not looked at; without any, nothing is learned.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    if fold is not None:
        rows = rows.where(remainder(F.col("doc_id")) != fold)
    rows = rows.select("lang", "text", F.xxhash64("text").alias("mark"))
    # the share of the range of hashes that holds about per_label texts
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("mark")).collect()
    if not counts:
        return train([], [])
    if len(counts) > FULL_BUDGET:
        per_label = min(per_label, max(8, per_label * FULL_BUDGET // len(counts)))
    below = [(lang, int(min(1.0, 1.5 * per_label / max(1, n) + 10 / max(1, n)) * (1 << 30))) for lang, n in counts]
    kind = rows.schema["lang"].dataType.simpleString()
    below = docs.sparkSession.createDataFrame(below, f"lang {kind}, below long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("mark"), pa.array([passages(x.as_py()) for x in batch.column("text")], pa.string())], ["lang", "mark", "text"])

    some = rows.join(F.broadcast(below), "lang").where(F.pmod("mark", F.lit(1 << 30)) < F.col("below")).select("lang", "mark", "text")
    some = some.mapInArrow(cut, f"lang {kind}, mark long, text string").groupBy("lang", "mark").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 30)), "mark")
    some = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label)
    sample = sorted(some.select("lang", "n", "text").collect())
    return train([r.text for r in sample], [r.lang for r in sample])


def predict_column(model: Model, column: pa.Array, group: int = 1 << 20) -> tuple[list[str], list[float]]:
    """Language and score of each text of an Arrow column.

    Texts go by length, so that chains of a group end together and only few
    groups have long ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    order = np.argsort(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), kind="stable")
    labels, scores = np.full(len(order), UNKNOWN, object), np.zeros(len(order))
    if not model.labels:
        return labels.tolist(), scores.tolist()
    for first in range(0, len(order), 1000):
        some = order[first : first + 1000]
        data, offsets = text_bytes(column.take(pa.array(some)))
        for a, b in slices(offsets, group):
            total = _label_sums(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            whole = total.sum(axis=1)
            best = np.argmax(total, axis=1)
            for k in np.flatnonzero(whole > 0).tolist():
                labels[some[a + k]] = model.labels[best[k]]
                scores[some[a + k]] = min(1.0, max(0.0, total[k, best[k]] / whole[k]))
    return labels.tolist(), scores.tolist()


def _label_sums(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, its letters by the probabilities of their words' labels."""
    emissions, letters, first = [], [], [np.zeros(1, np.int64)]
    for c, d in slices(offsets, 1 << 18):
        part = word_features(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])
        emissions.append(model.emissions(part))
        letters.append(part.letters)
        first.append(part.first[1:] + first[-1][-1])
    first, letters = np.concatenate(first), np.concatenate(letters)
    p = marginals(np.concatenate(emissions), first, model.transitions, model.starts)
    p *= letters[:, None]
    sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
    return sums[first[1:]] - sums[first[:-1]]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` of every row.  lang_pred is ``und`` with score
    0 where the text is null or has no letter, or nothing was learned.  Null and
    repeated keys are kept; other columns are not looked at."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict_column(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

    return rows.mapInArrow(label, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """``(word, language, probability)`` of the words of one text."""
    data, offsets = text_bytes(pa.array([text]))
    part = word_features(data, offsets)
    letter, _ = _letters()
    points = np.array([ord(c) for c in text], np.int64)
    starts, ends = runs(letter[points] if len(points) else np.zeros(0, bool), np.array([0, len(points)]))
    p = marginals(model.emissions(part), part.first, model.transitions, model.starts)
    return [(text[a:b], model.labels[int(np.argmax(q))], float(q.max())) for a, b, q in zip(starts, ends, p, strict=True)]


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language with this score at least,
    with their own columns.  Null text, and one without a letter, has none;
    repeated rows are judged alike; an empty table gives an empty one."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict_column(model, batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def predicted_folds(docs: DataFrame, **options) -> DataFrame:
    """Fits on the documents that are not held out and predicts all:
    doc_id, held_out, lang_pred, score.  Rows, nulls and empty tables as in
    :func:`predict`; a null doc_id is not held out."""
    made = predict(docs, fit(docs, **options))
    return made.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
