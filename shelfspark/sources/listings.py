"""Listings (JSON lines) and image metadata (CSV), compressed or not, with schemas of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import localized_pick

_VALUES = "array<struct<language_tag:string,value:string>>"
LISTING = f"""item_id string, product_type array<struct<value:string>>, country string, marketplace string, main_image_id string,
    other_image_id array<string>, item_name {_VALUES}, brand {_VALUES}, color {_VALUES}"""
IMAGE = "image_id string, height int, width int, path string"


def raw_listings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the listings at ``path`` (a glob), with the file and the place that order them. Raises if no file is there."""
    rows = spark.read.schema(LISTING).json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with reject_reason (null: kept) and multi_type (more than one product type)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(blank("item_id"), "no item_id").when(blank("main_image_id"), "no main_image_id")
    many = F.coalesce(F.size("product_type") > 1, F.lit(False)) & ~blank("item_id")
    return rows.withColumn("reject_reason", reason).withColumn("multi_type", many)


def listings(rows: DataFrame, subset: int | None = None) -> DataFrame:
    """Kept listings: ids, the first product type or UNKNOWN, and the preferred title, brand and colour.

    ``subset``: the first so many kept rows in the order of files and lines.
    """
    kept = judged(rows).where("reject_reason is null")
    if subset:
        kept = kept.orderBy("file", "line").limit(subset)
    title, brand, color = (localized_pick(F.col(c)) for c in ("item_name", "brand", "color"))
    first = F.get(F.col("product_type"), F.lit(0))["value"]
    return kept.select(
        F.col("item_id").alias("product_id"),
        F.coalesce(F.nullif(first, F.lit("")), F.lit("UNKNOWN")).alias("product_type_raw"),
        "country",
        "marketplace",
        "main_image_id",
        F.coalesce("other_image_id", F.array().cast("array<string>")).alias("other_image_ids"),
        title["value"].alias("title"),
        title["tag"].alias("title_lang"),
        brand["value"].alias("brand"),
        color["value"].alias("color"),
    )


def listing_counts(rows: DataFrame) -> DataFrame:
    """One row: listings_total, dropped_no_item_id, dropped_no_main_image, multi_product_type."""
    return judged(rows).agg(
        F.count("*").alias("listings_total"),
        F.count_if(F.col("reject_reason") == "no item_id").alias("dropped_no_item_id"),
        F.count_if(F.col("reject_reason") == "no main_image_id").alias("dropped_no_main_image"),
        F.count_if("multi_type").alias("multi_product_type"),
    )


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """image_id, orig_width, orig_height (of the original, not of the file) and path."""
    rows = spark.read.schema(IMAGE).csv(path, header=True, enforceSchema=False)
    return rows.select("image_id", F.col("width").alias("orig_width"), F.col("height").alias("orig_height"), "path")
