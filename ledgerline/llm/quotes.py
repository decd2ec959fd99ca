"""Quotation linking: nested quotes, the messages they come from, reply order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_in_parts, stored

_PREFIX = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: Who says what follows: such a word, and a colon at the line's end.
_WROTE = re.compile(r"(?:^|[^a-z])(?:wrote|writes|schrieb|écrit|escribió)(?:[^a-z]|$)", re.IGNORECASE | re.ASCII)
_BLANKS = " \t\r\f\v"
_LOOSE = re.compile(r"[\W_]+")
_PARAGRAPHS = re.compile(r"\n(?:[ \t]*\n)+")


def passages(text: str) -> list[tuple[int, str]]:
    """``(level, passage)``: runs of lines of one quote level, 0 for own words.

    A line's level is the number of ``>`` before its words.  Blank lines stay
    with what stands before them; a line that names who wrote what follows goes.
    Time grows with the text's length alone.
    """
    out: list[tuple[int, list[str]]] = []
    split = []
    for line in text.split("\n"):
        prefix = _PREFIX.match(line)
        split.append((prefix[1].count(">"), line[prefix.end() :]) if prefix else (0, line))
    told, deeper = 0, []  # the level of the next line that is not empty, from the end on
    for level, words in reversed(split):
        deeper.append(told > level)
        if level or words.strip(_BLANKS):
            told = level
    deeper.reverse()
    for k, (level, words) in enumerate(split):
        blank = not words.strip(_BLANKS)
        if blank and out and (level or (k + 1 < len(split) and not split[k + 1][0])):
            out[-1][1].append("")
        elif deeper[k] and words.rstrip(" \t").endswith(":") and _WROTE.search(words):
            continue
        elif out and out[-1][0] == level:
            out[-1][1].append(words)
        else:
            out.append((level, [words]))
    return [(level, "\n".join(x).strip("\n")) for level, x in out if any(y.strip(_BLANKS) for y in x)]


def own_text(text: str) -> str:
    return "\n".join(p for level, p in passages(text) if not level) if ">" in text else text


def passage_hash(passage: str) -> bytes | None:
    """Digest of a passage's words in lower case; None if it has none."""
    loose = _LOOSE.sub(" ", passage.lower()).strip()
    return hashlib.blake2b(loose.encode(), digest_size=16).digest() if loose else None


def _hashes(parts: list[str]) -> set[bytes]:
    return {passage_hash(x) for x in parts} - {None}


def units(text: str) -> set[bytes]:
    """Digests of what may be quoted of a message's own words: all of them, each
    paragraph, each line."""
    return _hashes([text, *_PARAGRAPHS.split(text), *text.split("\n")])


def quoted_parts(passage: str) -> list[tuple[int, bytes]]:
    """``(part, digest)``: the passage, its paragraphs, its lines, each digest
    once, as the largest part that has it."""
    whole = _hashes([passage])
    paragraphs = _hashes(_PARAGRAPHS.split(passage)) - whole
    lines = _hashes(passage.split("\n")) - whole - paragraphs
    return [(part, x) for part, found in ((WHOLE, whole), (PARAGRAPH, paragraphs), (LINE, lines)) for x in sorted(found)]


#: Quoted passages up to which they are broadcast, of some 60 bytes each.
BROADCAST_QUOTES = 200_000
#: How much of a passage a digest stands for; more goes before less.
WHOLE, PARAGRAPH, LINE = 2, 1, 0
_PARSED = "own string, units array<binary>, quotes array<struct<passage:int,level:int,part:int,hash:binary>>"
_QUOTES = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("part", pa.int32()), ("hash", pa.binary())]))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, msg (a digest of the text), own, units, quotes of every message."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("msg"), "text")
    held = ("conv_id", "turn", "role", "msg")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hashes, quoted = [], [], []
            for text in batch.column("text").to_pylist():
                quotes = []
                if ">" in text:
                    parts = passages(text)
                    for k, (level, words) in enumerate(parts):
                        if level:
                            quotes += [{"passage": k, "level": level, "part": part, "hash": x} for part, x in quoted_parts(words)]
                    text = "\n".join(p for level, p in parts if not level)
                own.append(text)
                hashes.append(sorted(units(text)))
                quoted.append(quotes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(own), pa.array(hashes, pa.list_(pa.binary())), pa.array(quoted, _QUOTES)], [*held, "own", "units", "quotes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(read, f"{kinds}, {_PARSED}")


def link_quotes(messages: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Reply-ordered conversations without quotes, from
    ``messages(conv_id, turn, role, text)``.

    One row per message: conv_id, turn, role, own_text, n_quotes (quoted
    passages with words), n_linked (those found in an earlier message of the
    conversation), reply_to (turn of the message answered: of the found quotes
    of the lowest level, the latest source; null without one), thread (turn of
    the first message of its chain of replies) and depth (replies from there).
    Ordered by conv_id, thread, turn, every reply follows what it answers, as
    reply_to is always less than turn.

    The source of a passage is the earliest message of the conversation with
    it among its own words, whole or as a paragraph or line; a passage that no
    message has whole is looked up by its paragraphs, and one of which no
    message has a paragraph by its lines.  A quote of a message that
    comes later is no link.  Messages are told apart by their text, too: of two
    that share a turn each has its own links and chain, and where both hold a
    passage the one of least digest is its source.  Null text is empty; a
    message with null conv_id or turn is kept and has no links; repeated rows
    are kept and share their links; an empty table gives an empty one; other
    columns are not looked at.

    Sources are a partial aggregate (least turn of each passage of a
    conversation), so a line that any number of messages share is one row, and
    each quote joins one row at most; the quotes of a passage, and the replies
    to a message, do so in parts.  Chains are followed by doubling.
    """
    parsed, me = parse(messages), ["conv_id", "turn", "msg"]
    quotes = parsed.select(*me, F.explode("quotes").alias("q")).select(*me, "q.*")
    quotes = stored(quotes.where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct())
    sources = parsed.where("turn IS NOT NULL").select("conv_id", F.struct("turn", "msg").alias("source"), F.explode("units").alias("hash"))
    # only conversations and passages with a quote matter
    wanted = quotes.select("conv_id", "hash").distinct()
    few = wanted.limit(BROADCAST_QUOTES + 1).count() <= BROADCAST_QUOTES
    sources = sources.join(F.broadcast(wanted), ["conv_id", "hash"], "left_semi") if few else sources
    sources = sources.groupBy("conv_id", "hash").agg(F.min("source").alias("source"))
    sources = sources if few else sources.join(wanted, ["conv_id", "hash"], "left_semi")
    found = join_in_parts(quotes, sources, ["conv_id", "hash"], ["turn", "msg", "passage"]).where("source.turn < turn")
    passage = found.groupBy(*me, "level", "passage").agg(F.max(F.struct("part", "source"))["source"].alias("source"))
    best = F.min(F.struct("level", (-F.col("source.turn")).alias("back"), F.col("source.msg").alias("to"))).alias("best")
    links = passage.groupBy(*me).agg(F.count("*").alias("n_linked"), best)
    links = stored(links.select(*me, "n_linked", (-F.col("best.back")).alias("reply_to"), F.col("best.to").alias("to")))

    up = links.select(*me, F.col("reply_to").alias("thread"), "to", F.lit(1).cast("long").alias("depth"))
    for _ in range(most_rounds):
        over = up.select("conv_id", F.col("turn").alias("thread"), F.col("msg").alias("to"), F.col("thread").alias("further"), F.col("to").alias("beyond"), F.col("depth").alias("more"))
        joined = join_in_parts(up, over, ["conv_id", "thread", "to"], ["turn", "msg"], "left")
        moved = F.col("further").isNotNull()
        up = stored(joined.select(*me, F.coalesce("further", "thread").alias("thread"), F.coalesce("beyond", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), moved.alias("moved")))
        if not up.where("moved").limit(1).count():
            break
        up = up.drop("moved")
    else:
        raise RuntimeError("chains of replies have not ended")

    links = links.drop("to").join(up.select(*me, "thread", "depth"), me)
    count = F.size(F.array_distinct(F.transform("quotes", lambda q: q.passage))).cast("long")
    rows = parsed.select(*me, "role", F.col("own").alias("own_text"), count.alias("n_quotes"))
    rows = rows.join(links, me, "left")
    return rows.select(
        "conv_id", "turn", "role", "own_text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
