"""Numpy views of Arrow text columns, and the word hashes computed from them.

All functions work on the UTF-8 bytes of many texts at once, so that no Python
object is made per word.  Words are the runs of bytes outside
``[\\x20\\x09-\\x0D]``, the same on bytes as on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64))
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_P, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(column, pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes; a longer row is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values that do not cross a row."""
    n = solid.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.ones(n, bool), np.ones(n, bool)
    np.logical_not(solid[:-1], out=first[1:])
    np.logical_not(solid[1:], out=last[:-1])
    first[offsets[:-1][offsets[:-1] < n]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    return np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes or numbers, whatever its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(data.size)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else splitmix(data)) * up[: data.size], out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the first and the end of its words."""
    starts, ends = runs(_SOLID[data], offsets)
    first = np.searchsorted(starts, offsets)
    return span_hashes(data, starts, ends), first[:-1], first[1:]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive hashes (rows not regarded)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * U64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return splitmix(total)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of ``size`` words.

    A row of fewer words, if any, has one shingle: all its words.
    """
    hashes, first, end = words(data, offsets)
    all_windows = windows(hashes, size)
    out = []
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(all_windows[a : b - size + 1]))
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which a sorted table's key differs from that of the row before."""
    n, new = table.num_rows, None
    for key in keys:
        column = table.column(key).combine_chunks()
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new = differs if new is None else new | differs
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches, cut anew so that no group is split, with the groups' bounds."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cuts = changes(table, keys) if table.num_rows > 1 else np.zeros(0, np.int64)
        if len(cuts):
            yield table.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
            rest = table.slice(int(cuts[-1]))
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])
