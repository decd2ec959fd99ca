"""Byte-level BPE: encoding by overlapping chunks, and decoding.

A text is cut into chunks that overlap.  Every chunk is pre-tokenised from its
own start, in parallel, and so may be wrong at both ends.  At its start it may
begin within a pre-token; at its end the pattern has not seen what follows, and
takes a run for ended or a contraction for none.  So a boundary counts as sure
only if the chunk goes on for :data:`AHEAD` characters behind it, which is
further than the pattern looks beyond the end of a pre-token.  The pattern reads
from left to right and never looks back, so from a boundary of the text on, a
later chunk that has the same boundary has the text's pre-tokens: the stitch
takes the earlier chunk up to the first sure boundary that both have and the
later chunk from it.  Without one the text is read anew from the last sure
boundary, over twice the length each time, until it meets a later chunk.  The
pieces are then merged by rank, each alone, and decoding concatenates the bytes
of ids.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Entries that a worker keeps of pieces and their ids, and the most characters
#: of a piece that is kept: at most some 200 bytes each, so 60 MB.
CACHED, CACHED_LENGTH = 300_000, 24
#: Characters behind a boundary that can change it: the pattern knows a pre-token
#: when it has seen two characters more (white space before a word, ``'re``).
AHEAD = 3


class _Ids(dict):
    """Ids of strings as little-endian unsigned 32-bit numbers, made when missing."""

    def __init__(self, encode, before: str = ""):
        super().__init__()
        self._encode, self._before = encode, before

    def __missing__(self, piece: str) -> bytes | None:
        if self._before and (not piece or piece[0].isspace() or piece[-1].isspace()):
            return None
        ids = self._encode(self._before + piece)
        made = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = made
        return made


class Codec:
    """The ranks of a ``.tiktoken`` file with the pattern that splits text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, rank in ranks.items():
            self._bytes[rank] = raw
        self._pieces, self._units = _Ids(self._merge), _Ids(self._merge, " ")

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.  The change from a character that is no white
        space to a space is always a boundary, so what stands between two such
        places is encoded alone and kept; strings of special tokens are text."""
        units = text.split(" ")
        if len(units) < 3 or units[0][-1:].isspace():
            return self._pack(self._merge(text))
        try:
            middle = b"".join(map(self._units.__getitem__, units[1:-1]))
        except TypeError:  # white space beside a space
            return self._pack(self._merge(text))
        return self._pack(self._merge(units[0])) + middle + self._pack(self._merge(" " + units[-1]))

    def encode_with(self, text: str, added: dict[str, int]) -> bytes:
        """Ids of a whole text in which the strings of ``added`` are tokens."""
        if not any(map(text.__contains__, added)):
            return self.encode(text)
        found = regex.split("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")", text)
        return b"".join(self._pack([added[x]]) if k % 2 else self.encode(x) for k, x in enumerate(found))

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens, each merged alone."""
        return b"".join(map(self._pieces.__getitem__, pieces))

    def piece_ids(self, pieces: list[str]) -> list[bytes]:
        return list(map(self._pieces.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[tuple[str, int], ...]:
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError("added tokens that strip or must be words are not read")
    return tuple((t["content"], t["id"]) for t in found)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, which the library finds in a text
    before it splits the rest."""
    return dict(_added(path))


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ends(pieces: list[str], start: int) -> np.ndarray:
    return start + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))


def _sure(ends: np.ndarray, stop: int, total: int) -> np.ndarray:
    """Those boundaries of a chunk that ends at ``stop`` which nothing behind it can change."""
    return ends if stop == total else ends[ends <= stop - AHEAD]


def takes(parts: list[tuple[int, int, np.ndarray]], text: str, split) -> list[tuple[int, int, int]]:
    """Which pre-tokens of overlapping parts make up those of ``text``.

    ``parts``: start, stop and ends of pre-tokens, as places in the text, in
    order, from 0 to the text's end.  Returns ``(part, first, last)`` in the
    order of the text: pre-tokens ``first:last`` of that part, or for part -1
    those that ``split`` finds between the boundaries first and last.
    """
    total, out, k, at = len(text), [], 0, 0  # at: a boundary of the text that part k has, too
    while True:
        start, stop, ends = parts[k]
        first = 0 if at == start else int(np.searchsorted(ends, at)) + 1
        if stop == total:
            return [*out, (k, first, len(ends))]
        sure = _sure(ends, stop, total)
        if meet := _met(parts[k + 1 : k + 2], sure[sure >= at], k + 1):
            then, now = meet
            out.append((k, first, int(np.searchsorted(ends, now, "right"))))
        else:
            if len(sure) and sure[-1] > at:
                out.append((k, first, len(sure)))
                at = int(sure[-1])
            size = 2 * (stop - start)
            while not meet:
                reach = min(total, at + size)
                sure = _sure(_ends(split(text[at:reach]), at), reach, total)
                end = k + 1
                while end < len(parts) and parts[end][0] < reach:
                    end += 1
                meet = _met(parts[k + 1 : end], np.concatenate([[at], sure]), k + 1)
                if reach == total and not meet:
                    return [*out, (-1, at, total)]
                size *= 2
            then, now = meet
            if now > at:
                out.append((-1, at, now))
        k, at = then, now


def _between(text: str, split, first: int, last: int) -> list[str]:
    """The pre-tokens between two boundaries of the text, read with what follows."""
    pieces = split(text[first : last + AHEAD])
    return pieces[: int(np.searchsorted(_ends(pieces, first), last, "right"))]


def _met(later: list[tuple[int, int, np.ndarray]], sure: np.ndarray, number: int) -> tuple[int, int] | None:
    """The first of the later parts with one of these boundaries, and the first of them."""
    for k, (start, _, ends) in enumerate(later, number):
        shared = np.intersect1d(sure, np.concatenate([[start], ends]))
        if len(shared):
            return k, int(shared[0])
    return None


def stitch(text: str, split, chunk: int, overlap: int) -> list[str]:
    """The pre-tokens of ``text``, from those of its overlapping chunks; any
    chunk of a character or more and any overlap give the same."""
    if chunk < 1 or overlap < 0:
        raise ValueError("a chunk has a character or more, an overlap none or more")
    if len(text) <= chunk + overlap:
        return split(text)
    pieces, parts = [], []
    for start in range(0, max(1, len(text) - overlap), chunk):
        pieces.append(split(text[start : start + chunk + overlap]))
        parts.append((start, min(len(text), start + chunk + overlap), _ends(pieces[-1], start)))
    out: list[str] = []
    for k, first, last in takes(parts, text, split):
        out += _between(text, split, first, last) if k < 0 else pieces[k][first:last]
    return out


ENCODED = "n_tokens long, ids binary, decoded binary"


def encode_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: tuple[str, str] | None = None, chunk: int = 4096, overlap: int = 256, apart: int = 65536
) -> DataFrame:
    """``(key, n_tokens, ids, decoded)`` of every row of ``docs``.

    ids: little-endian unsigned 32-bit numbers, as tiktoken's encode_ordinary
    gives; decoded: the bytes that they stand for.  ``ranks``: a rank file and
    its pattern, which must not look further than :data:`AHEAD` beyond the end
    of a pre-token, nor back.  chunk, overlap: in characters.  A text of more
    than ``apart`` characters goes out as parts of that length, with the
    overlap, which any tasks pre-tokenise and encode; the parts then meet, by
    the same stitch.  Every row is a text of its own there, under a number that
    is written out with the parts, so copies, null keys and repeated keys spread
    over all tasks.  Null text is empty, null and repeated keys are kept, an
    empty table gives an empty one, and other columns are not looked at.
    """
    ranks = ranks or default_ranks()
    if chunk < 1 or overlap < 0 or apart < 1:
        raise ValueError("a chunk and a part have a character or more, an overlap none or more")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, {ENCODED}"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*ranks)
        split = own.pattern.findall
        for batch in batches:
            for part in _small(batch):
                ids = [own.pieces(stitch(x, split, chunk, overlap)) for x in part.column("text").to_pylist()]
                yield _encoded(part.column("key"), ids, own)

    def apart_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*ranks)
        for batch in batches:
            for part in _small(batch, 50):
                ends, sizes, ids = [], [], []
                for x in part.column("text").to_pylist():
                    pieces = stitch(x, own.pattern.findall, chunk, overlap)
                    made = own.piece_ids(pieces)
                    ends.append(_ends(pieces, 0).tolist())
                    sizes.append([len(m) // 4 for m in made])
                    ids.append(b"".join(made))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ends, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(ids, pa.binary())],
                    [*part.schema.names, "ends", "sizes", "ids"],
                )

    def meet(table):
        own = codec(*ranks)
        table = table.sort_by("start")
        rows = table.select(["start", "text", "ends", "sizes", "ids"]).to_pylist()
        whole = "".join(r["text"][: n["start"] - r["start"]] for r, n in zip(rows, rows[1:], strict=False)) + rows[-1]["text"]
        parts = [(r["start"], r["start"] + len(r["text"]), np.asarray(r["ends"], np.int64) + r["start"]) for r in rows]
        cuts = [np.concatenate([[0], np.cumsum(np.asarray(r["sizes"], np.int64))]) * 4 for r in rows]
        split = own.pattern.findall
        anew = lambda x: stitch(x, split, chunk, overlap)
        ids = b"".join(own.pieces(_between(whole, anew, first, last)) if k < 0 else rows[k]["ids"][cuts[k][first] : cuts[k][last]] for k, first, last in takes(parts, whole, split))
        return _encoded(table.column("key").combine_chunks().slice(0, 1), [ids], own, table=True)

    long = F.length("text") > apart
    short = rows.where(~long).mapInArrow(near, schema)
    cut = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(apart))
    parts = rows.where(long).select("key", F.monotonically_increasing_id().alias("row"), "text").select("key", "row", "text", F.explode(cut).alias("start"))
    parts = stored(parts.select("key", "row", F.col("start").cast("long").alias("start"), F.expr(f"substring(text, start + 1, {apart + overlap})").alias("text")))
    made = parts.repartition("row", "start").mapInArrow(apart_parts, f"key {kind}, row long, start long, text string, ends array<long>, sizes array<int>, ids binary")
    whole = made.groupBy("row").applyInArrow(meet, schema)
    return short.unionByName(whole).withColumnRenamed("key", key)


def _small(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _encoded(keys: pa.Array, ids: list[bytes], own: Codec, table: bool = False):
    columns = [keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(list(map(own.decode, ids)), pa.binary())]
    return (pa.Table if table else pa.RecordBatch).from_arrays(columns, ["key", "n_tokens", "ids", "decoded"])


def digest_documents(docs: DataFrame, **options) -> DataFrame:
    """The digests of :func:`encode_documents`: doc_id, n_tokens, ids_sha256,
    decoded_sha256; rows, nulls and empty tables as there."""
    made = encode_documents(docs, **options)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
