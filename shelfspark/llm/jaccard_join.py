"""N-gram Jaccard join by signature trees: documents whose sets of word shingles are alike, and their components.

A document's set holds the hashes (64 bits) of its distinct shingles of five words. Equal sets are one node, told by 128
bits; a node goes by the first 64 of them unless two nodes have these in common. The rest works on nodes.

1. Keys. With shingles in one order for all, rarest first, two linked nodes share one of their first
   n - ceil(0.75 n) + 1; the first that they share is early in the smaller, one of its first n - ceil(6 n / 7) + 1. Rarity is a count over all documents in a table of fixed width, so words, lines and
   passages that many documents share come last and are seldom keys. Keys are range-sorted by (key, size, node), so a
   common key spans partitions, and a group is read off the sorted rows; nothing is gathered by key.
2. Pivots. In a group, a node of every 64 is a pivot, told by its own hash and so the same one in many groups, and so is
   the first of each range of sizes. Each node is paired with the pivot before it, and pivots likewise with one of 4096.
   Pairs that survive their bitmaps are verified by their shingles, and links join components. A second round pairs
   each node with the pivots of other components that are next to it by size, as far as bitmaps allow a link.
3. Trees. A group that still holds nodes of different components gets a signature tree: its nodes sorted by component
   and size, leaves of 64 nodes, inner nodes of 64 below them, each with the OR of the bitmaps, the range of sizes
   and the least number of bits that a link must share. A dual traversal starts at the root and itself and drops
   pairs whose sizes cannot match, whose common bits are too few for any link, or that lie in one component. Pairs of
   single nodes that are left, and that no round has tested, are verified by their shingles. Subtrees of one group in
   several partitions meet by a traversal of the levels above them.

No pruning loses a link: if at most n_a - o shingles of a are not in b, at most as many bits of a are not in b.
Bitmaps have two bits a shingle or more; in trees they are folded to 1024.

Hot groups: equal texts are one node; near copies end in one component after step 2 and are not compared again;
large groups are split over partitions, subtrees and leaves. No partner is capped. There is one way for all sizes.

Defined results: null and empty texts, or white space only, have an empty set, link with nothing and are their own
component; fewer than five words are one shingle. Very long texts are read whole, in batches bounded by bytes. Repeated
rows of a doc_id are given back each, in one component if their sets are equal. A null doc_id is never the name of a
component if there is another. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from ..operators.graph import connected_components
from ..plans.cut import bounded_batches, cut, dropped, release, tabled, width
from . import labelled

WORDS, PERCENT = 5, 75
#: Counters of shingles, by the first bits of their hash; bits of a tree's bitmaps; least and greatest width of a node's own bitmap, and the greatest that a tree's member carries; children of a tree's node.
COUNTERS, BITS, NARROWEST, WIDEST, CARRIED, FAN = 19, 10, 12, 17, 13, 64
#: Rounds of pivots. What they leave, however much, the trees find.
ROUNDS = 2
#: Pivots on either side of a member that a further round tries, and other keys that a tree's member carries.
NEAR, KEYS = 4, 16
#: Parts that a component's nodes are dealt over when they are named.
PARTS = 16
#: Members of a subtree that one task walks, and rows of the sorted keys that it reads at once.
SUBTREE, BLOCK = 4096, 200_000
#: Bits of the table that tells which documents are wanted, and sets that a task remembers.
WANTED, REMEMBERED = 23, 250_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ``text``; lower() and split() of bytes know ASCII only, as the words do."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, (text or b"").lower().split())), dtype="<u8")
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(size, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def name_of(found: np.ndarray) -> tuple[int, int]:
    """A set's 128 bits, as two numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(found.tobytes()))


def bitmap(found: np.ndarray) -> bytes:
    """A bit for each shingle at the first bits of its hash, as many as give two places a shingle, within limits."""
    width = min(WIDEST, max(NARROWEST, (2 * len(found) - 1).bit_length() if len(found) else 0))
    bits = np.zeros(1 << width, bool)
    bits[(found >> np.uint64(64 - width)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as ``size`` bytes: places that come to share one are combined by OR."""
    found = np.frombuffer(bits, dtype=np.uint8)
    if len(found) == size:
        return found
    return np.packbits(np.unpackbits(found).reshape(8 * size, -1).any(1))


def may_link(a: bytes, b: bytes, n_a: int, n_b: int, percent: int) -> bool:
    """Whether bitmaps allow a link of sets of these sizes."""
    size = min(len(a), len(b))
    x, y = folded(a, size), folded(b, size)
    common = int(np.bitwise_count(x & y).sum())
    need = -(-percent * (n_a + n_b) // (100 + percent))
    return int(np.bitwise_count(x).sum()) - common <= n_a - need and int(np.bitwise_count(y).sum()) - common <= n_b - need


def are_linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets have a similarity of ``percent`` / 100 or more."""
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return 100 * common >= percent * (len(a) + len(b) - common)


def counter_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTERS)).astype(np.int64)


def keys_of(found: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The shingles among which a linked set shares one, the first in the order (count, hash); and how many of them, which stand first, may be shared with a set that isn't smaller."""
    n = len(found)
    p = n - -(-percent * n // 100) + 1
    early = n - int(least_common(n, n, percent)) + 1
    place = counts[counter_of(found)] * n + np.arange(n)
    return found[np.partition(place, (early - 1, p - 1))[:p] % n], early


def row_marks(text: Column) -> list[Column]:
    """128 bits that tell a row's text, as two numbers, without Python."""
    return [F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(7919), text).alias("m2")]


def _sets(docs: DataFrame, size: int) -> tuple[DataFrame, str, np.ndarray]:
    """doc_id, m1, m2, n, h1 and h2 (the set's name) and bits of each row, in a table; its place; and how many documents have a shingle of each counter."""
    rows = docs.select("doc_id", *row_marks(F.col("text")), F.col("text").cast("binary").alias("text"))
    longs = [StructField(c, LongType()) for c in ("m1", "m2", "n", "h1", "h2")]
    schema = StructType([rows.schema["doc_id"], *longs, StructField("bits", BinaryType()), StructField("counts", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, dtype=np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            found = [shingles(t.as_py(), size) for t in batch.column(3)]
            if found:
                counts += np.bincount(counter_of(np.concatenate(found)), minlength=1 << COUNTERS)
            names = np.array([name_of(s) for s in found], dtype=np.int64).reshape(-1, 2)
            made = [pa.array(x) for x in ([len(s) for s in found], names[:, 0], names[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made[0].cast(pa.int64()), *made[1:], pa.array(list(map(bitmap, found)), pa.binary()), pa.nulls(len(found), pa.binary())], names=schema.names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *(pa.nulls(1, pa.int64()) for _ in longs), pa.nulls(1, pa.binary()), pa.array([labelled.packed(counts)], pa.binary())], names=schema.names)

    both, path = tabled(rows.mapInArrow(run, schema))
    none = np.zeros(1 << COUNTERS, dtype=np.int64)
    total = labelled.summed(both.where("counts is not null"), "counts", lambda arrays: sum((labelled.unpacked(x.as_py()) for a in arrays for x in a), none))
    return both.where("counts is null").drop("counts"), path, none if total is None else total


def _clashes(sets: DataFrame) -> list[int]:
    """First halves that sets with other second halves share: of m sets, m^2 / 2^65 may be expected, so none or very few."""
    met = sets.where("n > 0").groupBy("h1").agg(F.min("h2").alias("a"), F.max("h2").alias("b")).where("a <> b")
    return sorted(r.h1 for r in met.select("h1").collect())


def _node(h1: int, h2: int, clashes: frozenset[int]) -> int:
    return h2 if h1 in clashes else h1


def _keys(docs: DataFrame, counts: np.ndarray, clashes: list[int], size: int, percent: int) -> DataFrame:
    """(key, node, n) of each node and each of its keys; a node that a task meets again is left out there. n: twice the size, and 1 more for an early key."""
    held = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed width
    odd = frozenset(clashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = held.value, set()

        def handed(some: list) -> pa.RecordBatch:
            sizes = [len(k) for _, _, k, _ in some]
            early = np.concatenate([np.arange(len(k)) < e for _, _, k, e in some])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([k for _, _, k, _ in some]).view(np.int64)),
                    pa.array(np.repeat(np.array([x for x, _, _, _ in some], dtype=np.int64), sizes)),
                    pa.array(np.repeat(np.array([2 * n for _, n, _, _ in some], dtype=np.int32), sizes) + early.astype(np.int32)),
                ],
                names=["key", "node", "n"],
            )

        for batch in batches:
            some, rows = [], 0
            for text in batch.column(0):
                found = shingles(text.as_py(), size)
                if not len(found):
                    continue
                node = _node(*name_of(found), odd)
                if node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                some.append((node, len(found), *keys_of(found, counts, percent)))
                rows += len(some[-1][2])
                if rows >= 100_000:
                    yield handed(some)
                    some, rows = [], 0
            if some:
                yield handed(some)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, node long, n int")


def least_common(n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles that sets of these sizes share at least if linked."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def bits_fit(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of the unpacked bitmaps ``a`` and of ``b`` may be linked: a matrix."""
    n_a, n_b = n_a[:, None], n_b[None, :]
    common = a.astype(np.float32) @ b.astype(np.float32).T
    need = least_common(n_a, n_b, percent)
    only_a, only_b = a.sum(1)[:, None] - common, b.sum(1)[None, :] - common
    return (only_a <= n_a - need) & (only_b <= n_b - need) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def pivots(starts: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Of each row the row of its pivot, before it or itself; rows are sorted by group, size and node, ``starts``: where groups begin."""
    n = len(nodes)
    first = np.zeros(n, bool)
    first[starts] = True
    # rows of one range of sizes always fit each other by size
    ranges = np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / percent) + 1e-9)
    turn = first.copy()
    turn[1:] |= ranges[1:] != ranges[:-1]
    drawn = nodes.view(np.uint64) >> np.uint64(7)
    low = turn | (drawn % np.uint64(FAN) == 0)
    high = turn | (drawn % np.uint64(FAN * FAN) == 0)
    at = np.arange(n)
    near = np.maximum.accumulate(np.where(low, at, 0))
    before = lambda flags: np.concatenate([[0], np.maximum.accumulate(np.where(flags, at, 0))[:-1]]) if n else at
    group = np.maximum.accumulate(np.where(first, at, 0))
    out = np.where(low, np.maximum(before(high), group), near)
    out = np.where(high, np.maximum(before(turn), group), out)
    return np.where(first, at, out)


def _sorted_groups(rows: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """Groups of two nodes and more among ``rows``, as ``_keys`` gives them: key, node, n (a size), early, pivot and pivot_n.

    The first key that two linked nodes share is early in the smaller, so a group begins with a node in which it is.
    A range sort splits a large group over partitions; the first rows of its parts get the group's first as their pivot.
    Of each partition its first and its last group are told to the driver: two rows, whatever they hold. The groups lie in a
    table, whose place is given back too.
    """
    order = ["key", "n", "node"]
    dealt = rows.repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order)
    names = ["key", "node", "n", "early", "pivot", "pivot_n", "edge", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        begun = False

        def handed(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal begun
            key, node, n = columns
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, n, early = key[fresh], node[fresh], n[fresh] >> 1, (n[fresh] & 1).astype(bool)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lengths = np.diff(np.append(starts, len(key)))
            edge = np.zeros(len(starts), bool)
            edge[0] |= not begun
            edge[-1] |= last
            begun = True
            met = np.cumsum(early)
            met -= np.repeat(met[starts] - early[starts], lengths)
            keep = np.repeat(edge, lengths) | (met > 0)  # an edge may go on from another partition
            key, node, n, early = key[keep], node[keep], n[keep], early[keep]
            edge = np.repeat(edge, lengths)[keep]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            lengths = np.diff(np.append(starts, len(key)))
            pivot = pivots(starts, node, n, percent)
            keep = np.repeat(lengths > 1, lengths) | edge
            parts = np.where(edge, part, -1).astype(np.int32)
            out = [pa.array(x[keep]) for x in (key, node, n, early, node[pivot], n[pivot], parts)]
            yield pa.RecordBatch.from_arrays([*out, pa.nulls(len(out[0]), pa.int64())], names=names)
            at = starts[edge[starts]]
            told = [pa.array(x) for x in (key[at], node[at], n[at], early[at], node[at], n[at], np.full(len(at), part, np.int32), lengths[edge[starts]])]
            yield pa.RecordBatch.from_arrays(told, names=names)

        for columns, last in _whole_groups(batches, lambda b: [b.column(i).to_numpy() for i in range(3)], BLOCK):
            yield from handed(columns, last)

    found, path = tabled(dealt.mapInArrow(run, "key long, node long, n int, early boolean, pivot long, pivot_n int, edge int, members long"))
    by_key: dict[int, list] = {}
    for r in sorted(found.where("members is not null").collect(), key=lambda r: (r.key, r.edge)):
        by_key.setdefault(r.key, []).append(r)
    fixed = [(k, r.edge, r.node, None if len(v) == r.members == 1 else v[0].node, v[0].n) for k, v in by_key.items() for i, r in enumerate(v) if i or len(v) == r.members == 1]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    table = pa.table([pa.array(c, t) for c, t in zip(list(zip(*fixed, strict=True)) or [()] * 5, kinds, strict=True)], names=["key", "edge", "node", "whole", "whole_n"])
    told = F.broadcast(rows.sparkSession.createDataFrame(table).withColumn("met", F.lit(True)))  # two rows a partition at most
    known = found.where("members is null").drop("members").join(told, ["key", "edge", "node"], "left").where("met is null or whole is not null")
    return known.select("key", "node", "n", "early", F.coalesce("whole", "pivot").alias("pivot"), F.coalesce("whole_n", "pivot_n").alias("pivot_n")), path


def _whole_groups(batches: Iterator[pa.RecordBatch], columns_of: Callable[[pa.RecordBatch], list[np.ndarray]], most: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The columns of sorted batches in blocks of about ``most`` rows that end where the first column changes, and whether a block is the last."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(columns_of(batch))
        count += batch.num_rows
        if count >= most:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.searchsorted(columns[0], columns[0][-1]))
            if end:
                yield [x[:end] for x in columns], False
            held = [[x[end:] for x in columns]]
            count = len(held[0][0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)], True


def _stars(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes and their pivots, that fit by size."""
    fit = groups.where((F.col("node") != F.col("pivot")) & (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")))
    return fit.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _shingled(docs: DataFrame, wanted: DataFrame, clashes: list[int], size: int) -> DataFrame:
    """node and shingles of the nodes ``wanted`` (node, doc_id), and of few others; a node may have several equal rows.

    Documents go on if a table of fixed width marks their doc_id; of the others the text isn't looked at.
    """

    def marked(arrays: Iterable[pa.Array]) -> np.ndarray:
        table = np.zeros(1 << WANTED, bool)
        for x in arrays:
            table[x.to_numpy()] = True
        return np.packbits(table).view(np.int64)

    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << WANTED)).alias("slot")
    table = labelled.summed(wanted.select(slot("doc_id")), "slot", marked, np.bitwise_or)
    held, odd = docs.sparkSession.sparkContext.broadcast(np.zeros((1 << WANTED) // 64, np.int64) if table is None else table), frozenset(clashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table = held.value.view(np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            out, bulk = [], 0
            for row in np.flatnonzero((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).tolist():
                found = shingles(batch.column(1)[row].as_py(), size)
                node = _node(*name_of(found), odd) if len(found) else None
                if node is None or node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                out.append((node, found.tobytes()))
                bulk += 8 * len(found)
                if bulk > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "shingles"])
                    out, bulk = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "shingles"])

    return cut(docs.select(slot("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, shingles binary"))


class _Verifier(NamedTuple):
    """What verification needs: the texts, and node, doc_id, n and bits of each node that shares a key."""

    docs: DataFrame
    nodes: DataFrame
    clashes: list[int]
    size: int
    percent: int

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are linked: bitmaps go to all pairs, shingles to those whose bitmaps allow a link."""
        percent = self.percent

        @F.arrow_udf(BooleanType())
        def fits(bits_a: pa.Array, bits_b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
            rows = zip(bits_a, bits_b, n_a.to_pylist(), n_b.to_pylist(), strict=True)
            return pa.array([may_link(x.as_py(), y.as_py(), n, m, percent) for x, y, n, m in rows], pa.bool_())

        @F.arrow_udf(BooleanType())
        def linked(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([are_linked(*(np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in row), percent) for row in zip(a, b, strict=True)], pa.bool_())

        side = lambda df, x, *columns: df.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        both = pairs.join(side(self.nodes, "b", "n", "bits"), "b").join(side(self.nodes, "a", "n", "bits"), "a")
        fit = cut(both.where(fits("bits_a", "bits_b", "n_a", "n_b")).select("a", "b"))
        release(self.docs.sparkSession)
        wanted = self.nodes.join(fit.select("a").unionAll(fit.select("b")).distinct().withColumnRenamed("a", "node"), "node", "left_semi")
        sets = _shingled(self.docs, wanted.select("node", "doc_id"), self.clashes, self.size)
        out = cut(fit.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b").where(linked("shingles_a", "shingles_b")).select("a", "b").distinct())
        release(self.docs.sparkSession)
        return out


def _contested(shared: DataFrame, names: DataFrame | None) -> DataFrame:
    """Rows of groups that hold nodes of two components or more, with the component; of groups of the same nodes, one."""
    own = shared.withColumn("component", F.col("node")) if names is None else shared.join(names, "node", "left")
    known = own.select("key", "node", "n", "early", F.coalesce("component", "node").alias("comp"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"x{seed}") for seed in (1, 2)]
    groups = known.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("k"), *marks).where("c0 <> c1")
    return cut(known.join(groups.groupBy("k", "x1", "x2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))


def _unpacked(packed: Iterable[bytes]) -> np.ndarray:
    """Bits of bitmaps folded to the least width, a row each."""
    rows = [folded(x, (1 << BITS) // 8) for x in packed]
    return np.unpackbits(np.stack(rows), axis=1) if rows else np.zeros((0, 1 << BITS), np.uint8)


def _objects(some: list) -> np.ndarray:
    out = np.empty(len(some), object)
    out[:] = some
    return out


class Subtree(NamedTuple):
    """Members of a group in the order of their components and sizes, as arrays; bits: a folded bitmap each; keys: a row of other early keys of each, the least first; wide: their own bitmaps, as objects."""

    node: np.ndarray
    n: np.ndarray
    comp: np.ndarray
    early: np.ndarray
    bits: np.ndarray
    keys: np.ndarray
    wide: np.ndarray

    def part(self, at: int) -> Subtree:
        return Subtree(*(x[at * FAN : (at + 1) * FAN] for x in self))

    def packed(self) -> bytes:
        held = np.zeros(len(self.node), _MEMBER)
        for name in _MEMBER.names:
            held[name] = getattr(self, name)
        return pickle.dumps((held.tobytes(), self.wide.tolist()))

    @classmethod
    def of(cls, packed: bytes) -> Subtree:
        held, wide = pickle.loads(packed)
        held = np.frombuffer(held, dtype=_MEMBER)
        return cls(*(held[name] for name in _MEMBER.names), _objects(wide))

    def told(self, percent: int) -> tuple[np.ndarray, int, int, int, int | None]:
        """What a tree's node over all members knows: bits, least and greatest size, bits that a link shares at least, and the component if it is one."""
        own = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        need = int((own - self.n * (100 - percent) // 100).min())
        return np.bitwise_or.reduce(self.bits), int(self.n.min()), int(self.n.max()), need, int(self.comp[0]) if (self.comp == self.comp[0]).all() else None


def leaf_pairs(a: list[tuple], b: list[tuple], percent: int) -> np.ndarray:
    """Which pairs of tree nodes, as ``told``, may hold a link between components: a matrix."""
    bits = [np.unpackbits(np.stack([x[0] for x in z]), axis=1).astype(np.float32) for z in (a, b)]
    least, most, need = ([np.array([x[i] for x in z], dtype=np.int64) for z in (a, b)] for i in (1, 2, 3))
    sizes = (100 * most[0][:, None] >= percent * least[1][None, :]) & (100 * most[1][None, :] >= percent * least[0][:, None])
    enough = bits[0] @ bits[1].T >= np.maximum(need[0][:, None], need[1][None, :])
    apart = np.array([[x[4] is None or x[4] != y[4] for y in b] for x in a])
    return sizes & enough & apart


def compared(key: int, x: Subtree, y: Subtree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of two leaves that may be linked and are in two components.

    The key must be early in the smaller of a pair. A pair that shares a lesser key that is early in both is left to that
    key's tree, so pairs aren't made again and again. What the trees' bitmaps let pass is held against the members' own,
    where it lies: trees' bitmaps tell long sets badly, and pairs that nearly link would else go on by the square of a group.
    """
    fit = x.comp[:, None] != y.comp[None, :]
    if x is y:
        fit = np.triu(fit)
    smaller = np.where(x.n[:, None] <= y.n[None, :], x.early[:, None], False) | np.where(x.n[:, None] >= y.n[None, :], y.early[None, :], False)
    fit &= smaller
    if fit.any():
        fit &= bits_fit(np.unpackbits(x.bits, axis=1), np.unpackbits(y.bits, axis=1), x.n.astype(np.int64), y.n.astype(np.int64), percent)
    i, j = np.nonzero(fit)
    for at in range(0, len(i), 4096):  # of few pairs, each key with each
        some, other = x.keys[i[at : at + 4096]], y.keys[j[at : at + 4096]]
        shared = ((some[:, :, None] == other[:, None, :]) & (some[:, :, None] < key)).any((1, 2))
        i[at : at + 4096] = np.where(shared, -1, i[at : at + 4096])
    i, j = i[i >= 0], j[i >= 0]
    fit = np.fromiter((may_link(x.wide[a], y.wide[b], int(x.n[a]), int(y.n[b]), percent) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
    i, j = i[fit], j[fit]
    return np.minimum(x.node[i], y.node[j]), np.maximum(x.node[i], y.node[j])


def traversed(key: int, x: Subtree, y: Subtree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that a dual traversal of two subtrees of a key, or of one and itself, leaves."""
    same = x is y
    if same and len(x.node) <= FAN:  # the root is a leaf
        found = compared(key, x, x, percent)
        if len(found[0]):
            yield found
        return
    leaves = [[z.part(i) for i in range(-(-len(z.node) // FAN))] for z in ((x,) if same else (x, y))]
    told = [[leaf.told(percent) for leaf in z] for z in leaves]
    for i, j in zip(*np.nonzero(leaf_pairs(told[0], told[-1], percent)), strict=True):
        if not same or i <= j:
            found = compared(key, leaves[0][i], leaves[-1][j], percent)
            if len(found[0]):
                yield found


def near_pivots(starts: np.ndarray, group: Subtree, percent: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each member with the pivots next to it, ``NEAR`` on either side, that are of other components and may be linked; members are sorted by group and size."""
    count = len(group.node)
    lengths = np.diff(np.append(starts, count))
    rate = np.repeat(np.clip(lengths // (2 * NEAR), 1, FAN), lengths).astype(np.uint64)
    drawn = (group.node.view(np.uint64) ^ np.uint64(turn)) * _MIX[0] >> np.uint64(20)
    flags = drawn % rate == 0
    flags[starts] = True
    at = np.flatnonzero(flags)
    of = np.repeat(np.arange(len(starts)), lengths)
    own = np.bitwise_count(group.bits).sum(1, dtype=np.int64)
    n, rows = group.n.astype(np.int64), np.arange(count)
    place = np.searchsorted(at, rows)
    pairs = []
    for shift in range(-NEAR, NEAR + 1):
        other = at[np.clip(place + shift, 0, len(at) - 1)]
        a, b = rows[(other != rows) & (of[other] == of) & (group.comp[other] != group.comp)], None
        b = other[a]
        fit = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[fit], b[fit]
        common = np.bitwise_count(group.bits[a] & group.bits[b]).sum(1, dtype=np.int64)
        need = least_common(n[a], n[b], percent)
        fit = (own[a] - common <= n[a] - need) & (own[b] - common <= n[b] - need)
        pairs.append((group.node[a[fit]], group.node[b[fit]]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def _bitmapped(contested: DataFrame, nodes: DataFrame, order: list[str], *more: Column) -> DataFrame:
    """Rows of groups with bits, range-sorted by ``order``."""
    known = contested.join(nodes.select("node", "bits"), "node").select("key", "comp", "n", "node", "early", "bits", *more)
    return known.repartitionByRange(width(nodes.sparkSession), *order).sortWithinPartitions(*order)


def _small_bits(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([folded(x.as_py(), (1 << BITS) // 8) for x in batch.column("bits")])


def _carried(batch: pa.RecordBatch) -> np.ndarray:
    """Members' own bitmaps, of bounded width."""
    most = (1 << CARRIED) // 8
    return _objects([x if len(x) <= most else folded(x, most).tobytes() for x in batch.column("bits").to_pylist()])


def _again(contested: DataFrame, nodes: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of a further round of pivots: members and the pivots near them in their groups, of other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
            return [*(batch.column(c).to_numpy() for c in ("key", "node", "n", "comp")), _small_bits(batch)]

        for (key, node, n, comp, bits), _ in _whole_groups(batches, columns_of, BLOCK // 4):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            a, b = near_pivots(starts, Subtree(node, n, comp, None, bits, None, None), percent, turn)
            both = np.unique(np.stack([a, b], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return _bitmapped(contested, nodes, ["key", "n", "node"]).mapInArrow(run, "a long, b long").distinct()


_WALKED = "a long, b long, key long, at long, bits binary, least int, most int, need int, comp long, members binary"
_MEMBER = np.dtype([("node", "<i8"), ("n", "<i4"), ("comp", "<i8"), ("early", "?"), ("bits", "u1", (1 << BITS) // 8), ("keys", "<i8", KEYS)])


def _subtrees(rows: DataFrame, percent: int, subtree: int) -> DataFrame:
    """Of ``rows`` (key, comp, n, node, early, bits, keys), sorted: pairs (a, b) within each subtree; and the subtrees of groups that have, or may have, several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        turn, begun = 0, False
        empty = [pa.nulls(0, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())]
        names = [c.split()[0] for c in _WALKED.split(", ")]

        def pairs(key: int, tree: Subtree) -> Iterator[pa.RecordBatch]:
            for a, b in traversed(key, tree, tree, percent):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), e.type) for e in empty[2:])], names=names)

        def walked(key: int, group: Subtree, several: bool) -> Iterator[pa.RecordBatch]:
            nonlocal turn
            several |= len(group.node) > subtree
            for at in range(0, len(group.node), subtree):
                tree = Subtree(*(x[at : at + subtree] for x in group))
                if len(tree.node) > 1 and not (tree.comp == tree.comp[0]).all():
                    yield from pairs(key, tree)
                if several:
                    bits, least, most, need, comp = tree.told(percent)
                    values = [None, None, key, base + turn, bits.tobytes(), least, most, need, comp, tree.packed()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], e.type) for v, e in zip(values, empty, strict=True)], names=names)
                    turn += 1

        def groups(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal begun
            key = columns[0]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                edge = (not begun and i == 0) or (last and i == len(starts) - 1)
                yield from walked(int(key[s]), Subtree(*(x[s:e] for x in columns[1:])), edge)
            begun = True

        def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
            plain = [batch.column(c).to_numpy() for c in ("key", "node", "n", "comp")]
            early = batch.column("early").to_numpy(zero_copy_only=False)
            keys = np.full((batch.num_rows, KEYS), np.iinfo(np.int64).max)
            for row, some in enumerate(batch.column("keys").to_pylist()):
                keys[row, : len(some)] = some
            return [*plain, early, _small_bits(batch), keys, _carried(batch)]

        for columns, last in _whole_groups(batches, columns_of, BLOCK // 4):
            yield from groups(columns, last)

    return rows.mapInArrow(run, _WALKED)


def _above(level: DataFrame) -> DataFrame:
    """The level over ``level``: at most ``FAN`` children a node, so a group is bounded."""

    @F.arrow_udf(BinaryType())
    def joined(lists: pa.Array) -> pa.Array:
        return pa.array([np.bitwise_or.reduce(np.stack([np.frombuffer(b, dtype=np.uint8) for b in x])).tobytes() for x in lists.to_pylist()], pa.binary())

    return (
        level.withColumn("at", F.floor(F.col("at") / FAN).cast("long"))
        .groupBy("key", "at")
        .agg(F.collect_list("bits").alias("all"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("need").alias("need"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("comp").alias("k"), F.count("*").alias("c"))
        .select("key", "at", joined("all").alias("bits"), "least", "most", "need", F.when((F.col("k") == F.col("c")) & (F.col("c0") == F.col("c1")), F.col("c0")).alias("comp"))
    )


def _met(pairs: DataFrame, level: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (key, x, y) of nodes of ``level`` that may hold a link."""

    @F.arrow_udf(IntegerType())
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_unpacked(a.to_pylist()) & _unpacked(b.to_pylist())).sum(1).astype(np.int32))

    side = lambda x: level.select("key", F.col("at").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("bits", "least", "most", "need", "comp")))
    both = pairs.join(side("x"), ["key", "x"]).join(side("y"), ["key", "y"])
    apart = ~F.coalesce(F.col("comp_x") == F.col("comp_y"), F.lit(False))
    sizes = (100 * F.col("most_x") >= percent * F.col("least_y")) & (100 * F.col("most_y") >= percent * F.col("least_x"))
    enough = common("bits_x", "bits_y") >= F.greatest("need_x", "need_y")
    return both.where(apart & sizes).where(enough).select("key", "x", "y")


def _across(subtrees: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of two subtrees of one group, by a dual traversal of the levels above the subtrees."""
    order = Window.partitionBy("key").orderBy("at")  # a row for each subtree, so few even of a hot key
    tall = cut(subtrees.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1").withColumn("at", (F.row_number().over(order) - 1).cast("long")).drop("c"))
    levels = [tall.drop("members")]
    while (levels[-1].agg(F.max("at").alias("m")).first().m or 0) > 0:
        levels.append(cut(_above(levels[-1])))
    pairs = levels[-1].select("key", F.col("at").alias("x"), F.col("at").alias("y"))
    for level in reversed(levels[:-1]):
        below = level.select("key", "at", F.floor(F.col("at") / FAN).cast("long").alias("up"))
        child = lambda x: below.select("key", F.col("up").alias(x), F.col("at").alias(f"{x}_below"))  # noqa: E731, B023
        met = pairs.join(child("x"), ["key", "x"]).join(child("y"), ["key", "y"]).select("key", F.col("x_below").alias("x"), F.col("y_below").alias("y"))
        pairs = cut(_met(met.where("x < y"), level, percent).unionAll(met.where("x = y")))
    side = lambda x: tall.select("key", F.col("at").alias(x), F.col("members").alias(f"members_{x}"))
    both = pairs.where("x < y").join(side("x"), ["key", "x"]).join(side("y"), ["key", "y"]).select("key", "members_x", "members_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                trees = [Subtree.of(c[row].as_py()) for c in batch.columns[1:]]
                for a, b in traversed(batch.column(0)[row].as_py(), *trees, percent):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _tree_pairs(contested: DataFrame, nodes: DataFrame, percent: int, subtree: int) -> DataFrame:
    """Pairs (a, b) of nodes of two components that the dual traversal of each key's tree leaves."""
    early = F.sort_array(F.collect_list(F.when(F.col("early"), F.col("key"))))  # a node has no more keys than shingles
    known = contested.join(contested.groupBy("node").agg(F.slice(early, 1, KEYS).alias("keys")), "node")
    walked = cut(_subtrees(_bitmapped(known, nodes, ["key", "comp", "n", "node"], F.col("keys")), percent, subtree))
    release(nodes.sparkSession)
    return walked.where("a is not null").select("a", "b").unionAll(_across(walked.where("key is not null").drop("a", "b"), percent)).distinct()


class Joined(NamedTuple):
    """members: doc_id, m1, m2, n_shingles, node, comp (a node) and component_id of each row; links: verified pairs of nodes (a, b) that span the components."""

    members: DataFrame
    links: DataFrame


def similar(docs: DataFrame, percent: int = PERCENT, size: int = WORDS, rounds: int = ROUNDS, subtree: int = SUBTREE) -> Joined:
    """Joins ``docs`` (doc_id, text) with itself on shingle sets of Jaccard similarity ``percent`` / 100 or more.

    ``rounds`` of pivots and the members of a ``subtree`` change what is done first, not the result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sets, sets_path, counts = _sets(docs, size)
    clashes = _clashes(sets)
    node = F.when(F.col("h1").isin(clashes), F.col("h2")).otherwise(F.col("h1")) if clashes else F.col("h1")
    sets = sets.withColumn("node", F.when(F.col("n") > 0, node))
    members = cut(sets.select("doc_id", "m1", "m2", "n", "node"))
    nodes, nodes_path = tabled(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").cast("int").alias("n"), F.first("bits").alias("bits")))
    dropped(spark, sets_path)
    keyed, path = tabled(_keys(docs, counts, clashes, size, percent))
    shared, groups_path = _sorted_groups(keyed, percent)
    dropped(spark, path)
    release(spark)
    sharing, sharing_path = tabled(nodes.join(shared.select("node").distinct(), "node", "left_semi"))
    bare = cut(nodes.select("node", "doc_id"))
    dropped(spark, nodes_path)
    verified = _Verifier(docs, sharing, clashes, size, percent)
    links, tested, names = None, None, None  # names: of nodes that rounds have put in another's component
    rows = shared.select("key", "node", "n", "early")
    if not rounds:
        rows = _contested(rows, None)
        dropped(spark, groups_path)
    for turn in range(rounds):
        pairs = cut(_again(rows, sharing, percent, turn) if turn else _stars(shared, percent))
        found = verified(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        links, tested = (found, pairs) if links is None else (links.unionAll(found), tested.unionAll(pairs))
        names = connected_components(links)
        rows = _contested(rows, names)
        release(spark)
        if not turn:
            dropped(spark, groups_path)
    left = _tree_pairs(rows, sharing, percent, subtree)
    found = verified(left if tested is None else left.join(tested, ["a", "b"], "left_anti"))
    links = found if links is None else links.unionAll(found)
    dropped(spark, sharing_path)
    placed = bare.join(connected_components(links), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("comp"))
    # a component may hold a third of all nodes, so its rows are dealt over parts, and its name goes to each
    placed = cut(placed.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")))
    ids = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    named = cut(placed.join(ids, ["comp", "part"]).select("node", "comp", "component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = members.join(named, "node", "left").select("doc_id", "m1", "m2", F.col("n").alias("n_shingles"), "node", "comp", own.alias("component_id"))
    return Joined(out, links)


def components(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach, of each row of ``docs``."""
    return similar(docs, percent, size).members.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their component, one of each; all rows without words.

    A row is told by doc_id and its text, so of a doc_id with two texts each is judged by itself; of rows alike in both,
    one is kept, whatever their other columns. A null doc_id stands for a component only if no other does.
    """
    m1, m2, own, c1, c2 = labelled.unused_names(docs, 5)
    chosen = similar(docs, percent, size).members.where("node is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "m1", "m2")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias(own), F.col("c.m1").alias(c1), F.col("c.m2").alias(c2))
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    some = docs.where(worded).withColumns(dict(zip((m1, m2), row_marks(F.col("text")), strict=True)))
    some = some.dropDuplicates(["doc_id", m1, m2])
    kept = some.join(chosen, (F.col(m1) == F.col(c1)) & (F.col(m2) == F.col(c2)) & some.doc_id.eqNullSafe(F.col(own)), "left_semi")
    return kept.drop(m1, m2).unionAll(docs.where(~F.coalesce(worded, F.lit(False))))
