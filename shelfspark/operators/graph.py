"""Connected components: by contraction of partitions, and by large-star and small-star steps in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..plans.cut import cut

#: Edges that one task contracts, and parts of a hot component's rows where labels are handed down.
PER_TASK, SALTS = 250_000, 16


def _ends(edges: DataFrame, a: str, b: str) -> DataFrame:
    """hi and lo of each edge between two nodes; null ends and loops are none."""
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    return known.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of ``n`` nodes the least that edges (a, b) reach: roots hook to lesser ones, and pointers are halved."""
    label = np.arange(n)
    while len(a):
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            break
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        least = np.minimum(one, other)
        np.minimum.at(label, one, least)
        np.minimum.at(label, other, least)
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node that a partition's edges connect with each of its nodes, itself included."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    both = pa.chunked_array([b.column(i) for i in (0, 1) for b in held]).combine_chunks()
    names = both.dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    ends = place[names.indices.to_numpy()]
    half = len(ends) // 2
    label = least_labels(len(order), ends[:half], ends[half:])
    values = names.dictionary.take(pa.array(order))
    for at in range(0, len(order), 100_000):
        yield pa.RecordBatch.from_arrays([values[at : at + 100_000], values.take(pa.array(label[at : at + 100_000]))], names=["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = PER_TASK, max_levels: int = 60) -> DataFrame:
    """``(node, component)`` for each node of an edge that joins two different nodes; component: the least node.

    Each partition of at most about ``per_task`` edges is contracted where it lies, so of a hub one row a partition is
    left. A node's roots from several partitions are edges of the next, smaller graph; this goes on until one
    partition holds what is left, and labels are then handed down, level by level. Null ends and loops are no edges.
    Nodes of nested types go by ``star_components``. Raises if ``max_levels`` don't settle it.
    """
    if isinstance(edges.schema[a].dataType, (StructType, ArrayType)):
        return star_components(edges, a, b)  # Arrow can't hash nested values
    now = cut(_ends(edges, a, b))
    schema = StructType([StructField("node", now.schema["hi"].dataType), StructField("root", now.schema["hi"].dataType)])
    levels = []
    while True:
        tasks = -(-now.count() // per_task)
        alone = tasks <= 1
        roots = now.coalesce(max(1, tasks)).mapInArrow(_forest, schema)
        if alone:
            labels = roots.select("node", F.col("root").alias("component"))
            break
        met = cut(roots.groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots")))
        levels.append(met.select("node", F.col("roots")[0].alias("up")))
        now = cut(met.where(F.size("roots") > 1).select(F.explode(F.expr("slice(roots, 2, size(roots))")).alias("hi"), F.col("roots")[0].alias("lo")))
        if len(levels) > max_levels:
            raise RuntimeError(f"components did not settle in {max_levels} levels")
    for level in reversed(levels):
        above = labels.select(F.col("node").alias("up"), "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = level.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        labels = rows.join(above, ["up", "salt"], "left").select("node", F.coalesce("component", "up").alias("component"))
    return cut(labels)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    below = edges.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return below.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def star_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """As ``connected_components``, in DataFrame functions only, for nodes of any type that has an order.

    Each round is two joins on a node with a minimum per node, summed up before the shuffle; AQE splits the joins of a
    hub's edges. Long chains take rounds in the order of the logarithm of their length.
    """
    now = cut(_ends(edges, a, b).distinct())
    seen = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.hash("hi", "lo").cast("long")).alias("h")).first()
        marks = (row.n, row.h)
        if not row.n or marks == seen:
            members = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return members.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = marks
        now = cut(_small(_large(now)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
