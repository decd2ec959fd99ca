"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

After Bawa, Condie and Ganesan, "LSH Forest" (2005).  Every distinct text has a
signature; each tree sorts the texts by a label of several hashes of it, so that
a prefix of the label is a node of the tree's trie, and the texts under a node
stand together.  Each text sets out from its longest matched prefix, the whole
label, and goes up: level by level the prefixes are shortened by one hash, and
texts that share the shorter one are candidates, until

* the text's recall is reached: a set of n shingles can have only some
  similarities of the threshold or more, and the least of them says how short
  its prefix must become (:func:`stop_lengths`), or
* all texts that are left under the node are of one component already.

Copies are one class before the forest.  A trie is dealt by its nodes of the
least length that any text may need, and within a task the levels below run
over sorted labels.  Candidates are compared by signature alone, in blocks of a
fixed number of texts, and only edges that connect the close ones go out; in a
node of several blocks, what is close to its first text is compared with that
alone.  The components hold all candidates; only their texts are read again.
They meet once, in blocks, for exact verification of the pairs that share a
prefix, which gives counts of links and a spanning forest of them.  A component
that is a long chain, so that its nodes hold fewer pairs than itself, meets node
by node instead.  No pair is a row, but counting the links of n texts that are
all alike sends each of them to n / 256 pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import U64, shingles, slices, splitmix, text_bytes, whole_groups
from .graph import connected_components
from .shared import SALTS, each_salt, fresh, salt, salts, stored

TREES, LABEL = 16, 8
#: Texts of a block: a task compares two blocks at a time.
BLOCK = 256
#: Ids up to which those of all members are broadcast, of some 60 bytes each; more are joined.
BROADCAST_IDS = 400_000
_A = (splitmix(np.arange(1, TREES * LABEL + 1, dtype=np.uint64) * U64(0x9E37)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (splitmix(np.arange(1, TREES * LABEL + 1, dtype=np.uint64) * U64(0xC2B2)) >> U64(32)).astype(np.uint32)


def prefix_length(similarity: float, recall: float, trees: int = TREES, most: int = LABEL) -> int:
    """The longest prefix, shortened from the full label, at which a pair of
    this similarity shares a node of some tree with the target probability."""
    for k in range(most, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def stop_lengths(threshold: float, recall: float, sizes: int = 200) -> np.ndarray:
    """For sets of 0, 1, 2, ... shingles, how short a prefix must become.

    A set of n that shares i shingles with one of m has similarity
    ``i / (n + m - i)``; the least of these that is the threshold or more bounds
    the recall from below.  Larger sets than these count as reaching the
    threshold itself, which the last entry stands for.
    """
    share = Fraction(str(threshold))
    out = [LABEL]
    for n in range(1, sizes):
        least = Fraction(1)
        for i in range(math.ceil(share * n), n + 1):
            m = math.floor(i / share + i - n)
            if m >= i > 0:
                least = min(least, Fraction(i, n + m - i))
        out.append(prefix_length(float(least), recall))
    return np.array([*out, prefix_length(threshold, recall)], np.uint8)


def signature(found: np.ndarray) -> np.ndarray:
    """The least of each hash function over a set of shingles."""
    low = (found >> U64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(least, (low[k : k + 2048, None] * _A + _B).min(axis=0), out=least)
    return least


def node_keys(signatures: np.ndarray, prefix: int) -> np.ndarray:
    """A key of each tree's node at this depth, for rows of signatures."""
    labels = signatures.reshape(len(signatures), TREES, LABEL)
    key = np.broadcast_to(splitmix(np.arange(1, TREES + 1, dtype=np.uint64)), labels.shape[:2])
    for k in range(prefix):
        key = splitmix(key * U64(3) + labels[:, :, k])
    return key.view(np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least element of the component of each of n elements."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (further := root[root] != root).any():
            root[further] = root[root[further]]
    return root


def block_pairs(rows: DataFrame, size: str, key: str, *others: str) -> DataFrame:
    """``rows`` with ``bi <= bj``, once for each pair of blocks to which a row
    belongs, so that every two rows of a group meet in one pair of blocks."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(11)), blocks).cast("int")
    rows = rows.select(key, "id", *others, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return rows.select(key, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "id", *others)


def _met(table: pa.Table, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of whole groups that meet here: those of one block with
    itself, or those across two blocks."""
    own, bi, bj = (table.column(c).to_numpy() for c in ("own", "bi", "bj"))
    held_a, held_b, size = [], [], 0
    for a, b in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
        if b - a < 2:
            continue
        if bi[a] == bj[a]:
            x, y = np.triu_indices(b - a, 1)
        else:
            x, y = (m.ravel() for m in np.meshgrid(np.flatnonzero(own[a:b] == bi[a]), np.flatnonzero(own[a:b] == bj[a]), indexing="ij"))
        held_a.append(x + a)
        held_b.append(y + a)
        size += len(x)
        if size > 1 << 16:
            yield np.concatenate(held_a), np.concatenate(held_b)
            held_a, held_b, size = [], [], 0
    if size:
        yield np.concatenate(held_a), np.concatenate(held_b)


def _close(a: np.ndarray, b: np.ndarray, brief: np.ndarray, least: float) -> np.ndarray:
    """Which pairs share so many of their signatures' low bytes."""
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        s = slice(k, k + (1 << 15))
        out[s] = np.count_nonzero(brief[a[s]] == brief[b[s]], axis=1) >= least * brief.shape[1]
    return out


def _brief(table: pa.Table | pa.RecordBatch, name: str = "brief") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _edges(table: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A star for each component of the pairs, as rows (a, b)."""
    root = local_roots(table.num_rows, a, b)
    leaf = np.flatnonzero(root != np.arange(len(root)))
    ids = table.column("id").combine_chunks()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(leaf)), ids.take(pa.array(root[leaf]))], ["a", "b"])


def signed(texts: DataFrame, size: int, threshold: float, recall: float) -> DataFrame:
    """``texts(id, text)`` to ``(id, brief, keys, stop)``; a text without a word
    has none.  brief: the low bytes of the signature, tree by tree, which are
    the labels by which the tries are sorted; keys: in each tree the node of the
    least length that any text needs; stop: the length that this one needs."""
    stops = stop_lengths(threshold, recall)
    prefix = int(stops.min())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                sets = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                some = [k for k, x in enumerate(sets) if len(x)]
                if not some:
                    continue
                made = np.stack([signature(sets[k]) for k in some])
                low = (made & 255).astype(np.uint8)
                keys = node_keys(made, prefix)
                stop = stops[np.minimum([len(sets[k]) for k in some], len(stops) - 1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.array(some) + a)), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(stop)], ["id", "brief", "keys", "stop"]
                )

    return texts.mapInArrow(sign, "id binary, brief binary, keys array<long>, stop int")


def starred(rows: DataFrame, key: str, near, *others: str) -> tuple[DataFrame, DataFrame]:
    """Which pairs of ``rows(key, id, size, *others)`` are still to be compared
    where only the components of close pairs matter.

    ``rows`` are read several times.  A group of one block goes out as it is.  In
    a larger one each row is held against the group's first row by
    ``near(batch)``, where that one's columns begin with ``centre_``: those close
    to it are its star, and no two of them need to meet.  The rest meets all rows
    of the group, in pairs of blocks.  So a group in which all are close to the
    first costs one comparison a row.  Returns the stars' edges ``(a, b)`` and
    rows ``(key, bi, bj, own, id, *others)``.
    """
    zero = F.lit(0)
    small = rows.where(F.col("size") <= BLOCK).select(key, zero.alias("bi"), zero.alias("bj"), zero.alias("own"), "id", *others)
    large = rows.where(F.col("size") > BLOCK).select(key, "id", *others)
    first = large.groupBy(key).agg(F.min("id").alias("id")).join(large, [key, "id"])
    first = first.select(key, *(F.col(c).alias(f"centre_{c}") for c in ("id", *others)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "id", "centre_id")), pa.array(near(batch))], [key, "id", "centre", "core"])

    kind = large.schema[key].dataType.simpleString()
    parts = F.explode(F.sequence(zero, F.lit(SALTS - 1))).alias("part")
    first = first.select("*", parts)  # there are few, and each meets its group in parts
    marks = stored(large.withColumn("part", salt("id")).join(first, [key, "part"]).mapInArrow(mark, f"`{key}` {kind}, id binary, centre binary, core boolean"))
    sizes = marks.groupBy(key).agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rest")).where("n_rest > 0")
    rest, core = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("n_rest", "n_core"))
    mixed = F.xxhash64("id", F.lit(11))
    own = F.when(F.col("core"), rest + F.pmod(mixed, core)).otherwise(F.pmod(mixed, rest)).cast("int")
    met = F.sequence(zero, F.when(F.col("core"), rest).otherwise(rest + core) - 1)
    left = marks.withColumn("part", salt("id")).join(sizes.select("*", parts), [key, "part"]).join(large, [key, "id"]).select(key, "id", *others, own.alias("own"), F.explode(met).alias("other"))
    left = left.select(key, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "id", *others)
    return marks.where("core AND id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")), small.unionByName(left)


def linked(p: frozenset, q: frozenset, share: Fraction) -> bool:
    """Whether two sets of shingles have at least this Jaccard similarity."""
    if min(len(p), len(q)) * share.denominator < share.numerator * max(len(p), len(q)):
        return False
    both = len(p & q)
    return both * share.denominator >= share.numerator * (len(p) + len(q) - both)


def linked_to_first(size: int, threshold: float):
    """``near`` of :func:`starred` for whole texts, exact after signatures."""
    least, share = _least(threshold), Fraction(str(threshold))

    def near(batch: pa.RecordBatch) -> np.ndarray:
        out = np.count_nonzero(_brief(batch) == _brief(batch, "centre_brief"), axis=1) >= least * TREES * LABEL
        columns = [batch.column(c) for c in ("text", "centre_text", "centre_id")]
        known, first = None, frozenset()
        for k in np.flatnonzero(out).tolist():
            text, centre_text, centre = (c[k].as_py() for c in columns)
            if centre != known:
                known, first = centre, shingle_set(centre_text, size)
            out[k] = linked(shingle_set(text, size), first, share)
        return out

    return near


def shingle_set(text: str, size: int) -> frozenset:
    data = np.frombuffer(text.encode(), np.uint8)
    return frozenset(shingles(data, np.array([0, len(data)]), size)[0].tolist())


def _least(threshold: float) -> float:
    """The share of equal hashes below which a pair at the threshold falls only
    beyond five standard deviations."""
    return threshold - 5 * (threshold * (1 - threshold) / (TREES * LABEL)) ** 0.5


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of labels, the lengths of the prefixes that they share."""
    return np.cumprod(a == b, axis=-1, dtype=np.uint8).sum(axis=-1, dtype=np.uint8)


def populated(signs: DataFrame) -> DataFrame:
    """``(node, tree, id, size, brief, stop)`` of each node of two texts or more."""
    nodes = signs.select("id", salt("id").alias("part"), F.posexplode("keys").alias("tree", "node"))
    counts = nodes.groupBy("node").agg(F.count("*").alias("size"), salts("part").alias("bits")).where("size > 1")
    counts = counts.select("node", "size", each_salt("bits").alias("part"))
    return nodes.join(counts, ["node", "part"]).drop("part").join(signs.select("id", "brief", "stop"), "id")


def candidate_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of the candidates: texts that
    share a prefix as short as either needs, and whose signatures agree as far
    as a pair at the threshold does but for chance, five standard deviations
    below.  ``nodes`` are those of :func:`populated`, read several times."""
    least = _least(threshold)

    def near(batch: pa.RecordBatch) -> np.ndarray:
        return np.count_nonzero(_brief(batch) == _brief(batch, "centre_brief"), axis=1) >= least * TREES * LABEL

    stars, rows = starred(nodes, "node", near, "brief", "tree", "stop")
    rows = rows.withColumn("label", F.expr(f"substring(brief, tree * {LABEL} + 1, {LABEL})"))
    rows = rows.repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj", "label", "id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["node", "bi", "bj"]):
            brief, labels = _brief(table), _brief(table, "label")
            stop = table.column("stop").to_numpy().astype(np.uint8)
            root, found = np.arange(table.num_rows), []
            for a, b in _met(table, bounds):
                long = matched(labels[a], labels[b])
                allowed = long >= np.maximum(stop[a], stop[b])
                for level in range(LABEL, int(stop.min()) - 1, -1):  # prefixes grow shorter
                    now = np.flatnonzero(allowed & (long == level))
                    now = now[root[a[now]] != root[b[now]]]
                    now = now[_close(a[now], b[now], brief, least)]
                    if len(now):
                        found.append((a[now], b[now]))
                        root = local_roots(table.num_rows, *(np.concatenate(x) for x in zip(*found, strict=True)))
            if found:
                yield _edges(table, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return stars.unionByName(rows.mapInArrow(link, "a binary, b binary"))


def meetings(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where the texts of components meet: ``(place, tree, id, size)``.

    ``members(root, id, size)`` meet in their component, with tree -1.  A
    component of several blocks whose nodes hold fewer pairs than itself, as a
    chain's do, meets in these instead.  Both cover all candidates.
    """
    large = members.where(F.col("size") > BLOCK)
    own = F.md5(F.concat("root", F.col("node").cast("string").cast("binary"))).alias("place")
    held = nodes.select("id", "node", "tree").join(large.select("root", "id", F.col("size").alias("all")), "id").select("root", "all", own, "tree", "id", salt("id").alias("part"))
    counts = held.groupBy("place").agg(F.count("*").alias("size"), F.first("root").alias("root"), F.first("all").alias("all"), salts("part").alias("bits"))
    chains = counts.groupBy("root").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"), F.first("all").alias("all"))
    chains = stored(chains.where(F.col("pairs") < F.col("all").cast("double") * F.col("all")).select("root"))
    whole = members.join(chains, "root", "left_anti").select(F.hex("root").alias("place"), F.lit(-1).alias("tree"), "id", "size")
    if not chains.limit(1).count():
        return whole
    some = counts.join(chains, "root", "left_semi").where("size > 1").select("place", "size", each_salt("bits").alias("part"))
    return whole.unionByName(held.join(some, ["place", "part"]).select("place", "tree", "id", "size"))


def verified(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """Exact links among ``rows(place, bi, bj, own, tree, id, brief, keys, stop,
    text)``: rows ``(a, b, n)``, of which those with b are a spanning forest of
    the links and those without say how many links of a were found here.  Pairs
    that share no prefix as short as they need are no candidates; of a pair that
    meets in nodes of several trees the first counts."""
    least = _least(threshold)
    share = Fraction(str(threshold))
    rows = rows.repartition("place", "bi", "bj").sortWithinPartitions("place", "bi", "bj", "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["place", "bi", "bj"]):
            brief = _brief(table)
            labels = brief.reshape(-1, TREES, LABEL)
            keys = np.array(table.column("keys").to_pylist(), np.int64)
            stop, tree = table.column("stop").to_numpy().astype(np.uint8), table.column("tree").to_numpy()
            data, offsets = text_bytes(table.column("text"))
            sets: dict[int, frozenset] = {}

            def shingles_of(k: int) -> frozenset:
                if k not in sets:
                    if len(sets) >= 4 * BLOCK:
                        sets.clear()
                    a, b = offsets[k], offsets[k + 1]  # noqa: B023
                    sets[k] = frozenset(shingles(data[a:b], np.array([0, b - a]), size)[0].tolist())  # noqa: B023
                return sets[k]

            links = []
            for a, b in _met(table, bounds):
                close = _close(a, b, brief, least)
                a, b = a[close], b[close]
                for k in range(0, len(a), 1 << 12):
                    x, y = a[k : k + (1 << 12)], b[k : k + (1 << 12)]
                    met = keys[x] == keys[y]
                    here = (met & (matched(labels[x], labels[y]) >= np.maximum(stop[x], stop[y])[:, None])).any(axis=1)
                    here &= (tree[x] < 0) | (np.argmax(met, axis=1) == tree[x])
                    for i, j in zip(x[here].tolist(), y[here].tolist(), strict=True):
                        if linked(shingles_of(i), shingles_of(j), share):
                            links.append((i, j))
            if links:
                a, b = np.array(links).T
                edges = _edges(table, a, b)
                counts = np.bincount(np.concatenate([a, b]), minlength=table.num_rows)
                some = np.flatnonzero(counts)
                ids = table.column("id").combine_chunks().take(pa.array(some))
                yield pa.RecordBatch.from_arrays([edges.column(0), edges.column(1), pa.nulls(edges.num_rows, pa.int64())], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(some), pa.binary()), pa.array(counts[some].astype(np.int64))], ["a", "b", "n"])

    return rows.mapInArrow(check, "a binary, b binary, n long")


def text_id(text: str):
    """128 bits that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def classes(docs: DataFrame, key: str, text: str, size: int, threshold: float, recall: float, counted: bool = True) -> DataFrame:
    """A row for each distinct text: id, copy_of, times (documents with this key
    and text), bits (:func:`salts` of its keys), root (of its component of
    links) and, if ``counted``, n_links.

    Without the counts, what is linked to the first text of a component is
    compared with that alone.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_id(text).alias("id"))
    keys = rows.groupBy("id", "key").agg(F.count("*").alias("times")).withColumn("part", salt("key"))
    # of a struct the least; a null key comes last
    least = keys.groupBy("id").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "times")).alias("least"), salts("part").alias("bits"))
    named = least.select("id", F.col("least.key").alias("copy_of"), F.col("least.times").alias("times"), "bits")

    signs = signed(rows.select("id", "text"), size, threshold, recall)
    signs = stored(signs.groupBy("id").agg(*(F.first(c).alias(c) for c in ("brief", "keys", "stop"))))
    nodes = stored(populated(signs))
    components = connected_components(candidate_edges(nodes, threshold)).select("root", F.col("node").alias("id"), salt("node").alias("part"))
    sizes = components.groupBy("root").agg(F.count("*").alias("size"), salts("part").alias("bits"))
    members = stored(components.join(sizes.select("root", "size", each_salt("bits").alias("part")), ["root", "part"]).drop("part"))
    # only the texts of members move, and copies become one row in each task before
    ids = members.select("id")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = rows.select("id", "text").join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    texts = texts.join(signs, "id")
    places, held = meetings(members, nodes), ("tree", "brief", "keys", "stop", "text")
    places = places.join(texts, "id")
    if counted:
        checked = stored(verified(block_pairs(places, "size", "place", *held), size, threshold))
        links = checked.where("b IS NOT NULL").select("a", "b")
    else:
        stars, rest = starred(stored(places), "place", linked_to_first(size, threshold), *held)
        links = stars.unionByName(verified(rest, size, threshold).where("b IS NOT NULL").select("a", "b"))
    named = named.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left")
    columns = ["id", "copy_of", "times", "bits", F.coalesce("root", "id").alias("root")]
    if counted:
        counts = checked.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
        named = named.join(counts, "id", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return stored(named.select(*columns))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per document: key, copy_of, class_id, n_links.

    Two texts are linked if the sets of their runs of ``size`` words (between
    white space, as they are) have a Jaccard similarity of ``threshold`` or
    more; a text of fewer words is one run.  copy_of: least key of the documents
    with equal text; class_id: least key of the connected component of links;
    n_links: number of *different* texts linked to the document's text.
    ``recall`` bounds from below the chance that the forest brings a pair at
    the threshold together; pairs above it are found more surely, and what is
    found is verified exactly, on sets of 64-bit hashes of whole texts.

    Null text is empty; texts without a word are linked to nothing but their
    copies.  A null key is never the least, unless all keys are null.  Repeated
    rows are copies; other columns are not looked at.  An empty table gives an
    empty one.
    """
    named = classes(docs, key, text, size, threshold, recall).withColumn("part", salt("id"))
    ids = named.groupBy("root").agg(F.min("copy_of").alias("class_id"), salts("part").alias("parts"))
    named = named.join(ids.select("root", "class_id", each_salt("parts").alias("part")), ["root", "part"])
    named = named.select("id", "copy_of", "class_id", "n_links", each_salt("bits").alias("part"))
    rows = docs.select(F.col(key).alias("key"), text_id(text).alias("id")).withColumn("part", salt("key"))
    return rows.join(named, ["id", "part"]).select(F.col("key").alias(key), "copy_of", "class_id", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One document of each class, that of least key, with its own columns.

    Of rows that share this key and text, one stays; where all keys of a class
    are null, a row of the text with the least id.
    """
    named = classes(docs, key, text, size, threshold, recall, counted=False)
    order = F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "id", "times")
    chosen = named.groupBy("root").agg(F.min(order).alias("c")).select(F.col("c.id").alias("chosen_id"), F.col("c.copy_of").alias("chosen_key"), F.col("c.times").alias("chosen_times"))
    chosen = stored(chosen)
    own = fresh(docs, "text_id")
    rows = docs.withColumn(own, text_id(text))
    same = (rows[own] == F.col("chosen_id")) & rows[key].eqNullSafe(F.col("chosen_key"))
    once = rows.join(chosen.where("chosen_times = 1"), same, "left_semi").select(*docs.columns)
    several = chosen.where("chosen_times > 1")
    if not several.limit(1).count():
        return once
    return once.unionByName(rows.join(several, same, "left_semi").dropDuplicates([own]).select(*docs.columns))
