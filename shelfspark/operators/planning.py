"""Sample planning for shards: keys, roles, sidecars, invariants, and which shard a sample goes to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.scalars import sample_key


def packable(images: DataFrame) -> DataFrame:
    return images.where("plausible_product_photo").select("path", "split", "image_id", "orig_width", "orig_height").distinct()


def pairs_plan(pairs: DataFrame, fit: DataFrame, subset: int | None = None) -> DataFrame:
    """Pairs whose image can be packed, with a key that tells a product's rows apart. The order is total."""
    order = ["main_image_id", "main_image_path", "title", "title_lang", "product_type"]
    rows = pairs.join(fit.select("path", "image_id", "orig_width", "orig_height"), pairs.main_image_path == F.col("path"))
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("product_id").orderBy(*order)) - 1)
    out = rows.select(
        F.lit("pairs").alias("role"),
        sample_key(F.col("product_id"), F.col("occurrence")).alias("key"),
        "product_id",
        "title",
        "title_lang",
        "product_type",
        "split",
        F.col("main_image_id").alias("image_id"),
        "path",
        "orig_width",
        "orig_height",
        "occurrence",
    )
    return out.orderBy("product_id", "image_id", "path", "title", "title_lang", "product_type").limit(subset) if subset else out


def index_plan(fit: DataFrame, images: DataFrame, catalog: DataFrame, pairs: DataFrame, subset: int | None = None) -> DataFrame:
    """Images that no pair packs, each with its products as a sorted list. A product's repeats in the catalog repeat it."""
    rest = fit.join(pairs.select("path"), "path", "left_anti")
    each = rest.join(images.select("path", "product_id", "is_main"), "path").join(catalog.select("product_id", "product_type"), "product_id")
    product = F.struct("product_id", "is_main", "product_type")
    out = each.groupBy("path", "split", "image_id", "orig_width", "orig_height").agg(F.array_sort(F.collect_list(product)).alias("products"))
    out = out.select(F.lit("index").alias("role"), F.col("image_id").alias("key"), "path", "split", "image_id", "orig_width", "orig_height", "products")
    return out.orderBy("path").limit(subset) if subset else out


def straddling_paths(plan: DataFrame) -> DataFrame:
    """Paths in two splits or more."""
    return plan.groupBy("path").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def duplicate_keys(plan: DataFrame) -> DataFrame:
    return plan.groupBy("role", "key").agg(F.count("*").alias("n")).where("n > 1")


def missing_members(plan: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths that are planned and not there."""
    return plan.select("path").distinct().join(seen.select("path"), "path", "left_anti")


def rolled(rows: DataFrame, budget: int, order: str = "path", size: str = "n_bytes") -> DataFrame:
    """``rows`` with ``shard``: within (role, split), in order, a new shard begins once one holds ``budget`` bytes.

    The budget starts anew after each overshoot, so the state is sequential: one pass over a series in its order,
    a batch at a time.
    """
    schema = StructType([*rows.schema.fields, StructField("shard", IntegerType()), StructField("offset", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, shard, offset = None, 0, 0
        for batch in batches:
            shards, offsets = [], []
            for role, split, n in zip(batch["role"], batch["split"], batch[size], strict=True):
                if series != (role, split):
                    series, shard, offset = (role, split), 0, 0
                elif offset >= budget:
                    shard, offset = shard + 1, 0
                shards.append(shard)
                offsets.append(offset)
                offset += int(n)
            yield batch.assign(shard=shards, offset=offsets)

    return rows.repartition("role", "split").sortWithinPartitions("role", "split", order, "key").mapInPandas(run, schema)


def series_stats(rolled_rows: DataFrame, size: str = "n_bytes") -> DataFrame:
    return rolled_rows.groupBy("role", "split").agg(F.count("*").alias("samples"), F.sum(size).cast("long").alias("payload_bytes"), F.countDistinct("shard").alias("shards"))
