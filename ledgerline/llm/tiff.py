"""TIFF files in a column: a reader of pages, and a writer for round trips.

The reader walks the image directories of classic and big TIFF in either byte
order, takes strips or tiles, decodes none, PackBits, LZW and deflate, undoes
horizontal differencing and the floating-point predictor, and gives a row per
page.  Samples have 1, 2, 4, 8, 16 or 32 bits.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, ADOBE_DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", ADOBE_DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
_SINGLES = [bytes([k]) for k in range(256)]
_RUN = re.compile(rb"(.)\1{2,127}", re.S)


class TiffError(ValueError):
    """What is wrong with a file or page."""


# -- PackBits --------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(stop: int) -> None:
        for k in range(at, stop, 128):
            part = data[k : min(k + 128, stop)]
            out.append(_SINGLES[len(part) - 1] + part)

    for run in _RUN.finditer(data):
        literal(run.start())
        out.append(bytes([257 - (run.end() - run.start())]) + run[1])
        at = run.end()
    literal(len(data))
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, got, n = [], 0, 0, len(data)
    while at < n and got < size:
        head = data[at]
        if head < 128:
            part = data[at + 1 : at + 2 + head]
            if len(part) <= head:
                raise TiffError("PackBits data ends within a run")
            at += head + 2
        elif head > 128:
            if at + 1 >= n:
                raise TiffError("PackBits data ends within a run")
            part = data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        got += len(part)
    return b"".join(out)


# -- LZW, most significant bit first, code lengths changed early -----------


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [256], [9]
    table, free, width = {}, 258, 9
    find = table.get
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = find(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(width)
        table[key] = free
        free += 1
        prefix = byte
        if free == 4094:
            codes.append(256)
            widths.append(width)
            table.clear()
            free, width = 258, 9
        elif free >> width:
            width += 1
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        free += 1
        if free >> width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    code, bits = np.array(codes, np.uint16), np.array(widths, np.int64)
    spread = (code[:, None] << (16 - bits)[:, None].astype(np.uint16)).astype(">u2").view(np.uint8)
    return np.packbits(np.unpackbits(spread, axis=1)[np.arange(16) < bits[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    out, got = [], 0
    table = [*_SINGLES, b"", b""]
    pool = held = at = 0
    width, last = 9, b""
    limit = 511
    while got < size:
        while held < width:
            more = data[at : at + 4]
            if not more:
                if got:
                    return b"".join(out)  # no end code
                raise TiffError("LZW data ends early")
            pool = (pool & ((1 << held) - 1)) << (8 * len(more)) | int.from_bytes(more, "big")
            held += 8 * len(more)
            at += 4
        held -= width
        code = pool >> held & ((1 << width) - 1)
        if code < 256 or code > 257:
            if not last:
                if code > 255:
                    raise TiffError("LZW data begins with an unknown code")
                last = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                    table.append(last + entry[:1])
                elif code == len(table):
                    entry = last + last[:1]
                    table.append(entry)
                else:
                    raise TiffError("LZW data has an unknown code")
                last = entry
                if len(table) >= limit and width < 12:
                    width += 1
                    limit = (1 << width) - 1
            out.append(last)
            got += len(last)
        elif code == 256:
            table = [*_SINGLES, b"", b""]
            width, last, limit = 9, b"", 511
        else:
            break
    return b"".join(out)


def _decode(method: int, data: bytes, size: int) -> bytes:
    if method == NONE:
        return data
    if method == PACKBITS:
        return packbits_decode(data, size)
    if method == LZW:
        return lzw_decode(data, size)
    if method in (ADOBE_DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    raise TiffError(f"compression {method} is not known")


# -- reading ---------------------------------------------------------------

#: Bytes of a page or tile: a value of a column holds no more.
MOST_BYTES = (1 << 31) - 1
_SIZES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    count, entry, word, inline = ("Q", "HHQ", "Q", 8) if big else ("H", "HHI", "I", 4)
    try:
        (at,) = struct.unpack_from(order + word, data, 8 if big else 4)
        seen = set()
        while at:
            if at in seen:
                raise TiffError("the directories form a loop")
            seen.add(at)
            if at > len(data):
                raise TiffError("the file ends within a directory")
            (n,) = struct.unpack_from(order + count, data, at)
            at += struct.calcsize(order + count)
            tags = {}
            for _ in range(n):
                tag, kind, items = struct.unpack_from(order + entry, data, at)
                place = at + struct.calcsize("<" + entry)
                at = place + inline
                if kind not in _SIZES:
                    continue
                size = items * struct.calcsize(order + _SIZES[kind])
                if size > inline:
                    (place,) = struct.unpack_from(order + word, data, place)
                if place + size > len(data):
                    tags[tag] = None  # its page alone cannot be read
                    continue
                tags[tag] = struct.unpack_from(f"{order}{items}{_SIZES[kind]}", data, place)
            yield tags | {-1: (order,)}
            (at,) = struct.unpack_from(order + word, data, at)
    except struct.error:
        raise TiffError("the file ends within a directory") from None


def _unpacked(raw: bytes, lines: int, count: int, depth: int, kind: np.dtype) -> np.ndarray:
    """Samples of whole rows, each row begun at a byte."""
    if depth >= 8:
        return np.frombuffer(raw, kind, lines * count).reshape(lines, count)
    row = -(-count * depth // 8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, lines * row).reshape(lines, row), axis=1)[:, : count * depth]
    return bits.reshape(lines, count, depth) @ (1 << np.arange(depth)[::-1]).astype(np.uint8)


def _undone(part: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """Rows of samples (lines, across, inner) before they were differenced."""
    if predictor == 2:
        return np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("=")).astype(part.dtype)
    lines, across, inner = part.shape
    size = part.dtype.itemsize
    planes = np.frombuffer(part.tobytes(), np.uint8).reshape(lines, across * size, inner)
    planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(lines, size, across * inner)
    joined = np.ascontiguousarray(np.moveaxis(planes, 1, 2)).reshape(lines, -1)  # most significant byte first
    return joined.view(f">u{size}").astype(f"{order}u{size}").reshape(lines, across, inner)


def read_page(data: bytes, tags: dict[int, tuple]) -> dict:
    """A directory's image: its form, and its samples row by row.

    Samples of fewer than 8 bits become bytes; those of more stay as they are in
    the file.  Sample format 3 (floating point) is read, others count as whole
    numbers.  :class:`TiffError` if the page is damaged or of another kind.
    """

    def one(tag: int, default: int | None = None) -> int:
        value = tags.get(tag, ())
        if value is None or not value and default is None:
            raise TiffError(f"tag {tag} is missing")
        if value and not 0 <= value[0] < 1 << 63:
            raise TiffError(f"tag {tag} has no such value")
        return value[0] if value else default

    width, height, samples, method, predictor = one(256), one(257), one(277, 1), one(259, 1), one(317, 1)
    one(258, 1)
    bits = set(tags.get(258) or (1,))
    if len(bits) > 1 or not bits <= {1, 2, 4, 8, 16, 32}:
        raise TiffError(f"samples of {sorted(bits)} bits are not read")
    depth, separate, order = bits.pop(), one(284, 1) == 2, tags[-1][0]
    real = one(339, 1) == 3
    if predictor not in (1, 2, 3) or predictor == 2 and depth < 8 or predictor == 3 and not (real and depth > 8):
        raise TiffError(f"predictor {predictor} is not known for such samples")
    if real and depth < 16:
        raise TiffError(f"floating-point samples of {depth} bits are not read")
    kind = np.dtype("u1" if depth <= 8 else f"{order}u{depth // 8}")
    tiled = 324 in tags
    across, down = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    planes, inner = (samples, 1) if separate else (1, samples)
    if not (width and height and across and down and samples):
        raise TiffError("the image has no size")
    if max(width * height * samples, across * down * inner) * kind.itemsize > MOST_BYTES:
        raise TiffError(f"an image or tile of over {MOST_BYTES} bytes")
    offsets, counts = (tags.get(324 if tiled else 273) or ()), (tags.get(325 if tiled else 279) or ())
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) != columns * rows * planes or len(counts) != len(offsets):
        raise TiffError("the number of strips or tiles is wrong")
    image = np.zeros((planes, height, width, inner), kind)
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, columns * rows)
        top, left = place // columns * down, place % columns * across
        lines = down if tiled else min(down, height - top)
        whole = lines * (across * inner * kind.itemsize if depth >= 8 else -(-across * inner * depth // 8))
        if at < 0 or size < 0 or at + size > len(data):
            raise TiffError("a strip or tile ends beyond the file")
        raw = _decode(method, data[at : at + size], whole)
        if len(raw) < whole:
            raise TiffError("a strip or tile is too short")
        part = _unpacked(raw, lines, across * inner, depth, kind).reshape(lines, across, inner)
        if predictor > 1:
            part = _undone(part, predictor, order)
        image[plane, top : top + lines, left : left + across] = part[: height - top, : width - left]
    if separate:
        image = np.moveaxis(image, 0, 3)[..., 0, :]
    form = {"width": width, "height": height, "bits": depth, "samples": samples, "compression": NAMES.get(method, str(method)), "predictor": predictor, "tiled": tiled, "segments": len(offsets)}
    levels = image.view(f"{order}f{depth // 8}") if real else image
    return {**form, "pixels": image.tobytes(), **_features(levels.ravel())}


def _features(values: np.ndarray) -> dict:
    """Mean and deviation of the samples, and the entropy of their values in bits."""
    if values.dtype.itemsize <= 2 and values.dtype.kind == "u":
        share = np.bincount(values.astype(np.uint16) if values.dtype.itemsize == 2 else values) / len(values)
        levels = np.arange(len(share))
    else:
        levels, share = np.unique(values.astype(values.dtype.newbyteorder("=")), return_counts=True)
        levels, share = levels.astype(np.float64), share / len(values)
    mean = float(share @ levels)
    some = share[share > 0]
    return {"mean": mean, "deviation": math.sqrt(max(0.0, float(share @ (levels - mean) ** 2))), "entropy": float(-(some * np.log2(some)).sum())}


# -- writing ---------------------------------------------------------------


def write_tiff(pages: list[bytes], width: int = 64, method: int = ADOBE_DEFLATE, predictor: int = 1, tiled: bool = False, down: int = 128) -> bytes:
    """A little-endian file whose pages are 8-bit grey images, ``width`` wide.
    Each page has whole rows; strips and tiles are ``down`` rows high."""
    out, at, link = [b"II*\0\0\0\0\0"], 8, 4
    places: list[tuple[int, int]] = []  # of the links, and what stands there
    for page in pages:
        image = np.frombuffer(page, np.uint8).reshape(-1, width)
        spots, sizes = [], []
        for top in range(0, len(image), down):
            part = image[top : top + down]
            if tiled and len(part) < down:
                part = np.vstack([part, np.zeros((down - len(part), width), np.uint8)])
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            raw = part.tobytes()
            raw = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, ADOBE_DEFLATE: lambda x: zlib.compress(x, 1)}[method](raw)
            raw += b"\0" * (len(raw) % 2)
            spots.append(at)
            sizes.append(len(raw))
            out.append(raw)
            at += len(raw)
        lists = b""
        values = [(256, 4, width), (257, 4, len(image)), (258, 3, 8), (259, 3, method), (262, 3, 1), (277, 3, 1), (317, 3, predictor)]
        values += [(322, 4, width), (323, 4, down)] if tiled else [(278, 4, down)]
        for tag, items in (((324, spots), (325, sizes)) if tiled else ((273, spots), (279, sizes))):
            if len(items) == 1:
                values.append((tag, 4, items[0]))
            else:
                values.append((tag, 4, at + len(lists), len(items)))
                lists += struct.pack(f"<{len(items)}I", *items)
        out.append(lists)
        at += len(lists)
        places.append((link, at))
        entries = b"".join(struct.pack("<HHII", tag, kind, n[0] if n else 1, value) for tag, kind, value, *n in sorted(values))
        out.append(struct.pack("<H", len(values)) + entries + b"\0\0\0\0")
        link = at + 2 + len(entries)
        at += len(out[-1])
    made = bytearray(b"".join(out))
    for where, what in places:
        struct.pack_into("<I", made, where, what)
    return bytes(made)


# -- columns ---------------------------------------------------------------

PAGE = "page int, width int, height int, bits int, samples int, compression string, predictor int, tiled boolean, segments int, pixels binary, mean double, deviation double, entropy double, error string"


def tiff_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """A row per page of each file in the column ``media``, with the other
    columns of ``files``.

    Columns: page (from 0), width, height, bits, samples, compression,
    predictor, tiled, segments, pixels (the samples, row by row, in the file's
    byte order; bytes where a sample has fewer bits), mean, deviation, entropy,
    error.  A page that cannot be read, be it damaged, of another kind or of
    over 2 GB, gives a row whose error says why, and the pages after it are
    read; so does a file without a header, or whose directories end or loop,
    after the pages before that.  A null or empty file gives one row: of nulls,
    or an error.  Repeated rows are read each; no rows give none.  A column of
    ``files`` with one of these names is an error, which is raised before
    anything runs.
    """
    names = [x.split()[0] for x in PAGE.split(", ")]
    if taken := {c.lower() for c in files.columns} & set(names):
        raise ValueError(f"columns {sorted(taken)} would stand twice")
    kinds = dict(zip(names, (x.split()[1] for x in PAGE.split(", ")), strict=True))
    arrow = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}

    def pages(data: bytes | None) -> Iterator[dict]:
        if data is None:
            yield {}
            return
        number = 0
        try:
            for number, tags in enumerate(directories(data), 1):
                try:
                    yield {"page": number - 1, **read_page(data, tags)}
                except TiffError as e:
                    yield {"page": number - 1, "error": str(e)}
            if not number:
                raise TiffError("the file has no directory")
        except TiffError as e:
            yield {"page": number, "error": str(e)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found, source = [], []
                for k, data in enumerate(part.column(part.schema.get_field_index(media))):
                    for page in pages(data.as_py()):
                        found.append(page)
                        source.append(k)
                kept = part.take(pa.array(source, pa.int64()))
                made = [pa.array([p.get(n) for p in found], arrow[kinds[n]]) for n in names]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*part.schema.names, *names])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read, f"{out}, {PAGE}")


#: Ways in which ``texts_to_tiff`` stores a text; the payload's checksum picks one.
WAYS = ((PACKBITS, 1, False), (LZW, 1, False), (ADOBE_DEFLATE, 2, False), (ADOBE_DEFLATE, 1, True), (PACKBITS, 1, True), (LZW, 1, True), (ADOBE_DEFLATE, 2, True), (NONE, 1, False))


def texts_to_tiff(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as UTF-8, with bytes 0 up
    to a positive multiple of 64, as the 8-bit samples of a page 64 wide.  Null
    and repeated keys are kept; an empty table gives an empty one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                raw = [(x.as_py() or "").encode() for x in part.column("text")]
                media = []
                for x in raw:
                    x += b"\0" * (max(64, -(-len(x) // 64) * 64) - len(x))
                    media.append(write_tiff([x], 64, *WAYS[zlib.crc32(x) % len(WAYS)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", F.col(text).alias("text"))
    return rows.mapInArrow(write, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as a TIFF, reads it back, and digests both forms; rows,
    nulls and empty tables as in :func:`texts_to_tiff`."""
    pages = tiff_pages(texts_to_tiff(docs))
    size = F.length("pixels")
    feature = F.format_string("tiff %dx%d %s predictor %d %s mean %.4f deviation %.4f entropy %.4f", "width", "height", "compression", "predictor", F.when(F.col("tiled"), "tiles").otherwise("strips"), "mean", "deviation", "entropy")
    return pages.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "error",
    )
