"""Sharding along a Hilbert curve over several metadata dimensions.

Size, source and language of a document are each quantised to a cell of 0 to 255: size by its logarithm, names by
quantiles of the documents in the order of names, so a cell is a range of names and of like numbers of documents. The
three cells give a place on a Hilbert curve. Sorting by it and cutting equal runs makes shards whose rows lie close in
every dimension, so a filter on any of them prunes most files by their least and greatest cells.

Defined results: a null text has no bytes and CRC 0; a null source or language has cell 0; equal rows get
different slots, ties on the curve going by size, CRC and doc_id; an empty table gives no rows. Texts are read whole,
however long. Extra columns are ignored, also ones named like ours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.cut import ranked, running

BITS = 8


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of the points in the rows of ``axes`` (n, dimensions), each 0 to 2^bits - 1."""
    x = [axes[:, i].astype(np.int64) for i in range(axes.shape[1])]
    n = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:  # undo the excess turns of each level
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = high
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> b) & 1)
    return out


def quantiles(docs: DataFrame, column: str, cells: int = 1 << BITS) -> tuple[list[str], list[int]]:
    """The least name of each cell, and the cell, from 1 on: at most ``cells`` - 1, whatever the number of names."""
    counts = docs.select(F.col(column).cast("string").alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    placed, whole = running(counts, ["name"], {"upto": "n"})
    cell = F.floor((F.col("upto") - F.col("n")) * (cells - 1) / F.lit(max(whole["upto"], 1))) + 1
    found = sorted((r.cell, r.name) for r in placed.groupBy(cell.cast("int").alias("cell")).agg(F.min("name").alias("name")).collect())
    return [r[1] for r in found], [r[0] for r in found]


def cells_of(names: pd.Series, known: tuple[list[str], list[int]]) -> np.ndarray:
    """The cell of each name: that of the greatest least name which isn't above it; 0 for null."""
    codes, values = pd.factorize(names)
    cells = np.array([known[1][max(int(np.searchsorted(known[0], v, side="right")) - 1, 0)] for v in values] + [0], dtype=np.int64)
    return cells[codes]  # null has code -1, the last


def hilbert_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Cuts ``docs`` (doc_id, text, lang, source) into ``shards`` runs along the curve, of counts at most one apart.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), and per row the cells and
    the place on the curve. Only these narrow columns are shuffled, once; the range sort deals a hot source over
    many partitions, as the ties within a place are ordered by size, CRC and doc_id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long")
    langs, sources = quantiles(docs, "lang", 1 << BITS), quantiles(docs, "source", 1 << BITS)

    @F.pandas_udf("struct<lang:int,source:int,curve:long>")
    def place(lang: pd.Series, source: pd.Series, size_cell: pd.Series) -> pd.DataFrame:
        a, b = cells_of(lang, langs), cells_of(source, sources)
        return pd.DataFrame({"lang": a, "source": b, "curve": hilbert(np.stack([a, b, size_cell], axis=1))})

    narrow = docs.select(
        "doc_id",
        (size + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.least(F.lit(255), F.floor(12 * F.log2(size + F.lit(1.0)))).cast("int").alias("size_cell"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    ).withColumn("at", place("lang", "source", "size_cell"))
    narrow = narrow.select("doc_id", "size", "text_crc32", "size_cell", F.col("at.source").alias("source_cell"), F.col("at.lang").alias("lang_cell"), F.col("at.curve").alias("curve"))
    out, total = ranked(narrow, ["curve", "size", "text_crc32", "doc_id"], "_rank")
    shard = F.expr(f"(_rank * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"((_shard * {total}L) + {shards - 1}L) div {shards}L")
    return out.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "size_cell",
        "source_cell",
        "lang_cell",
        "curve",
    )
