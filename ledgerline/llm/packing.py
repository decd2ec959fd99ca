"""Cost-balanced packing of token ids into sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import added_tokens, codec, default_ranks, default_tokenizer

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def capacities(tokens: int, most: int) -> list[int]:
    """Room of the sequences for so many tokens: as many of ``most`` as they
    fill, and the rest as distinct powers of two, which need no padding."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(lengths: list[int], most: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` that fill
    ``capacities(sum(lengths), most)`` exactly.

    A piece of n tokens costs ``linear * n + quadratic * n * n``.  Documents go
    in descending order; what is longer than a sequence fills whole ones, and
    the rest goes to the sequence of lowest cost that has room left, cut where
    that room ends.  Ties: the earlier document, the earlier sequence.
    """
    room = capacities(sum(lengths), most)
    used = [0] * len(room)
    pieces, fill = [], 0
    rest = []
    for doc, n in enumerate(lengths):
        for k in range(n // most):
            pieces.append((doc, k * most, most, fill, 0))
            used[fill] = most
            fill += 1
        if n % most:
            rest.append((-(n % most), doc, n - n % most))
    lowest = [(0.0, s) for s in range(fill, len(room))]
    for left, doc, start in sorted(rest):
        left = -left
        while left:
            cost, s = heapq.heappop(lowest)
            n = min(left, room[s] - used[s])
            pieces.append((doc, start, n, s, used[s]))
            used[s] += n
            start, left = start + n, left - n
            if used[s] < room[s]:
                heapq.heappush(lowest, (cost + linear * n + quadratic * n * n, s))
    return pieces


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    ranks: tuple[str, str] | None = None,
    tokenizer: str | None = None,
    most: int = 1024,
    end: int = 0,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    block_tokens: int = 1 << 21,
) -> DataFrame:
    """Pieces of every document, in sequences of at most ``most`` tokens.

    A document is the ids of its text (null: none) and the id ``end``.  The ids
    are those of the file ``tokenizer`` without special tokens put around the
    text: of its vocabulary and merges, which ``ranks`` holds too, and of its
    added tokens where a text has their strings.  Each task packs its documents
    in blocks of about ``block_tokens`` tokens, which bound its memory and stay
    the same however large the input; a block's sequences are all full, but for
    at most ten whose lengths are distinct powers of two.  So no document moves
    between tasks, nothing is padded, and a lost task is made again alone.

    Columns: key, start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers), doc_tokens, sequence_id (distinct over tasks),
    offset, sequence_tokens, sequence_cost.  Null keys, repeated rows and empty
    tables need no special case; other columns are not looked at.
    """
    ranks, added = ranks or default_ranks(), added_tokens(tokenizer or default_tokenizer())
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, made = codec(*ranks), TaskContext.get().partitionId(), 0
        for keys, ids in _blocks(batches, lambda x: own.encode_with(x, added) + last, block_tokens):
            lengths = [len(x) // 4 for x in ids]
            pieces = assign(lengths, most, linear, quadratic)
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            cost = np.bincount(sequence, linear * length + quadratic * length * length)
            views = [memoryview(x) for x in ids]
            crcs = [zlib.crc32(views[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
            columns = [
                pa.concat_arrays(keys).take(pa.array(doc)),
                *map(pa.array, (start, length)),
                pa.array(crcs, pa.int64()),
                *map(pa.array, (np.array(lengths, np.int64)[doc], (np.int64(task) << 40) + made + sequence, offset, np.bincount(sequence, length).astype(np.int64)[sequence], cost[sequence])),
            ]
            made += int(sequence.max()) + 1
            yield pa.RecordBatch.from_arrays(columns, ["key", *(x.split()[0] for x in PIECES.split(", "))])

    return rows.mapInArrow(pack, f"key {kind}, {PIECES}").withColumnRenamed("key", key)


def _blocks(batches, encode, block_tokens: int) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    keys, ids, size = [], [], 0
    for batch in batches:
        first = 0
        for k, text in enumerate(batch.column("text")):
            ids.append(encode(text.as_py() or ""))
            size += len(ids[-1]) // 4
            if size >= block_tokens:
                yield [*keys, batch.column("key").slice(first, k + 1 - first)], ids
                keys, ids, size, first = [], [], 0, k + 1
        if first < batch.num_rows:
            keys.append(batch.column("key").slice(first))
    if ids:
        yield keys, ids


def padding_share(pieces: DataFrame, most: int = 1024) -> DataFrame:
    """One row: tokens, padded (to ``most``, except at a power of two), share."""
    n = F.col("n")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(most - n)
    got = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("tokens"), F.sum(pad).alias("padded"))
    return got.withColumn("share", F.col("padded") / (F.col("padded") + F.col("tokens")))
