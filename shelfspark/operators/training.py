"""What training reads and reports: masks of false negatives, contrastive loss, encoding once, run ids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Settings that don't change what a run computes: fixed values.
NOT_HASHED = ("shards_dir", "text_emb_dir", "runs_dir", "num_workers", "notes", "max_minutes", "excluded_from_hash")


def false_negatives(samples: DataFrame) -> DataFrame:
    """(batch, i, j), i <> j, of samples (batch, i, product_hash, title_hash) of one product or one title that isn't 0."""
    a = samples.select("batch", "i", "product_hash", "title_hash")
    b = samples.select("batch", F.col("i").alias("j"), "product_hash", "title_hash")
    product = a.join(b, ["batch", "product_hash"]).where("i <> j").select("batch", "i", "j")
    title = a.where("title_hash <> 0").join(b.where("title_hash <> 0"), ["batch", "title_hash"]).where("i <> j").select("batch", "i", "j")
    return product.unionByName(title).distinct()


def info_nce(samples: DataFrame, scale: float = 100.0) -> DataFrame:
    """(batch, loss, loss_i2t, loss_t2i, accuracy, masked) of each batch of samples (batch, i, image, text, product_hash, title_hash).

    A batch is of bounded size, as training has it. Cells of false negatives are left out of the sums.
    """

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("i")
        x, y = (np.stack([np.asarray(v, dtype=np.float64) for v in batch[c]]) for c in ("image", "text"))
        p, t = batch["product_hash"].to_numpy(), batch["title_hash"].to_numpy()
        mask = (p[:, None] == p) | ((t[:, None] == t) & (t[:, None] != 0))
        np.fill_diagonal(mask, False)
        logits = np.where(mask, -np.inf, scale * x @ y.T)

        def loss(z: np.ndarray) -> float:
            top = z.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(z - top).sum(1)) + top[:, 0] - np.diag(z)))

        i2t, t2i = loss(logits), loss(logits.T)
        right = float((logits.argmax(1) == np.arange(len(batch))).mean())
        return pd.DataFrame({"batch": [batch["batch"].iloc[0]], "loss": [(i2t + t2i) / 2], "loss_i2t": [i2t], "loss_t2i": [t2i], "accuracy": [right], "masked": [int(mask.sum())]})

    return samples.groupBy("batch").applyInPandas(one, "batch long, loss double, loss_i2t double, loss_t2i double, accuracy double, masked long")


def encode_distinct(rows: DataFrame, column: str, encode: Callable[[list[str]], np.ndarray], name: str = "vector") -> DataFrame:
    """``rows`` with ``name``, ``encode`` having seen each distinct value of ``column`` once."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(values.tolist()), dtype=np.float32)))

    known = rows.select(F.col(column).alias("_value")).where("_value is not null").distinct().withColumn(name, run("_value"))
    return rows.join(known, rows[column] == known["_value"], "left").drop("_value")


def looked_up(rows: DataFrame, vectors: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows with their vector, and those without one."""
    return rows.join(vectors, key), rows.join(vectors.select(key), key, "left_anti")


def usable_batches(rows: DataFrame, vectors: DataFrame, key: str = "key", least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows of ``rows`` (batch, key and others) with their vector, and (batch, dropped) of each batch.

    A batch with fewer than ``least`` vectors is left out whole: one sample has no negatives, so its loss is 0 and says nothing.
    """
    met, _ = looked_up(rows, vectors, key)
    counts = rows.join(vectors.select(key, F.lit(1).alias("known")), key, "left").groupBy("batch").agg(F.count("known").alias("usable"), F.count("*").alias("n"))
    kept = counts.where(F.col("usable") >= least)
    dropped = counts.select("batch", F.when(F.col("usable") >= least, F.col("n") - F.col("usable")).otherwise(F.col("n")).alias("dropped"))
    return met.join(kept.select("batch"), "batch", "left_semi"), dropped


def with_titles(samples: DataFrame) -> DataFrame:
    """``samples`` of pairs; one without a title is an error, not a row that is trained on an empty text."""
    bare = [r.key for r in samples.where("title is null or trim(title) = ''").select("key").limit(3).collect()]
    if bare:
        raise ValueError(f"samples without a title: {bare}")
    return samples


def run_id(settings: dict) -> str:
    """Twelve digits for what a run computes: the SHA-1 of its sorted settings."""
    kept = {k: v for k, v in settings.items() if k not in NOT_HASHED}
    return hashlib.sha1(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:12]
