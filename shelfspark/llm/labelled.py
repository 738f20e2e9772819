"""What the classifiers share: the learning rows, and sums of arrays over partitions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5
#: Learning rows at most; a bound of the method, whatever the input.
MAX_ROWS = 16_000
#: Partial sums that meet in one task, or in the driver at the end.
FAN_IN = 16


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id always is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, balanced: bool = False) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most ``max_rows`` labelled documents that aren't held out.

    The sample is that of the least hashes of doc_id, of each class alike if ``balanced``. Its bound is why it may be
    broadcast. Of a doc_id with several texts that of the least hash is taken. Rows of ``labels`` with another label or none are left out; of contradicting rows the greatest counts.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    if balanced:
        ones, zeros = (known.where(F.col("y") == y).orderBy(*order).limit(max_rows // 2) for y in (1, 0))
        known = ones.unionAll(zeros)
    else:
        known = known.orderBy(*order).limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # a doc_id may be that of many rows
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("doc_id", "text", "y")


def packed(array: np.ndarray) -> bytes:
    """An int64 array, compressed: signs go to the last bit, and bytes of one weight lie together, as most numbers are small."""
    x = np.ascontiguousarray(array, dtype=np.int64).ravel()
    signless = ((x << 1) ^ (x >> 63)).view(np.uint8).reshape(-1, 8)
    return zlib.compress(np.ascontiguousarray(signless.T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def summed(df: DataFrame, column: str, work: Callable[[Iterator[pa.Array]], np.ndarray], plus: Callable = np.add) -> np.ndarray | None:
    """The sum, by ``plus``, over all partitions of the int64 array that ``work`` makes of a partition's ``column``; None without rows.

    Each partition gives one array; ``FAN_IN`` of them are added in a task, and so on, so no task and not the driver
    meets more than that many. Arrays travel compressed.
    """
    rows = df.select(column)
    parts = max(1, rows.rdd.getNumPartitions())

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        some = next((b for b in batches if b.num_rows), None)
        if some is not None:
            got = work(b.column(0) for b in chained(some, batches))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(got)], pa.binary())], names=["part", "data"])

    def add(group: pa.Table) -> pa.Table:
        total = None
        for data in group.column("data"):
            more = unpacked(data.as_py())
            total = more.copy() if total is None else plus(total, more, out=total)
        return pa.table({"part": group.column("part").slice(0, 1), "data": pa.array([packed(total)], pa.binary())})

    out = rows.mapInArrow(one, "part long, data binary")
    while parts > FAN_IN:
        out = out.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(add, "part long, data binary")
        parts = -(-parts // FAN_IN)
    total = None
    for row in out.select("data").collect():
        more = unpacked(row.data)
        total = more.copy() if total is None else plus(total, more, out=total)
    return total


def summed_rows(df: DataFrame, column: str, work: Callable[[Iterator[pa.Array]], np.ndarray], rows: int, width: int, block: int = 512, finish: Callable[[np.ndarray], np.ndarray] = np.asarray, kind: type = np.int64) -> np.ndarray:
    """As ``summed``, of arrays of whole numbers, of ``rows`` by ``width``, for tables too large to travel whole.

    A partition gives its table in blocks of rows, without those that are all zero; blocks are added by number, ``FAN_IN`` at
    a time, so that a task meets a block of so many tables, and the driver each block once. There ``finish`` turns a block's
    rows, each by itself, into numbers of the ``kind`` that is given back, so the driver holds no table of sums.
    """
    some = df.select(column)
    parts = max(1, some.rdd.getNumPartitions())
    names = ["part", "block", "data"]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        got, part = work(b.column(0) for b in chained(first, batches)), TaskContext.get().partitionId()
        for at in range(0, rows, block):
            if (held := got[at : at + block]).any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([at // block], pa.int64()), pa.array([packed(held)], pa.binary())], names=names)

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for data in group.column("data"):
            total = total + unpacked(data.as_py())
        return pa.table({"part": group.column("part").slice(0, 1), "block": group.column("block").slice(0, 1), "data": pa.array([packed(total)], pa.binary())})

    out = some.mapInArrow(one, "part long, block long, data binary")
    while parts > 1:
        out = out.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part", "block").applyInArrow(add, "part long, block long, data binary")
        parts = -(-parts // FAN_IN)
    total = np.zeros((rows, width), kind)
    for r in out.select("block", "data").collect():
        held = finish(unpacked(r.data).reshape(-1, width))
        total[r.block * block : r.block * block + len(held)] = held
    return total


def chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def unused_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return list(islice((name for i in count() if (name := f"_own{i}") not in taken), n))
