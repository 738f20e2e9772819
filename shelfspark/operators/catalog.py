"""The catalog: edges, pruning, splits by component, long-tail types, tables and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import hash_split, plausible_photo
from ..plans.cut import running
from .graph import connected_components

#: An image of more products than this is generic; the share of listings whose types are kept: fixed values.
GENERIC_CAP, KEPT_SHARE = 50, 0.90


def edges_of(listings: DataFrame) -> DataFrame:
    """(product_id, image_id, is_main): a row for the main image and one for each other, repeats kept."""
    main = listings.select("product_id", F.col("main_image_id").alias("image_id"), F.lit(True).alias("is_main"))
    other = listings.select("product_id", F.explode("other_image_ids").alias("image_id"), F.lit(False).alias("is_main"))
    return main.unionByName(other)


def with_images(edges: DataFrame, images: DataFrame) -> DataFrame:
    """Edges whose image is known, with its path and size."""
    return edges.join(images, "image_id").select("product_id", "image_id", "is_main", "path", "orig_width", "orig_height")


def generic_images(edges: DataFrame, cap: int = GENERIC_CAP) -> DataFrame:
    """(image_id, n_products) of images on more than ``cap`` products."""
    return edges.groupBy("image_id").agg(F.countDistinct("product_id").alias("n_products")).where(F.col("n_products") > cap)


def prune(edges: DataFrame, generic: DataFrame) -> DataFrame:
    return edges.join(generic.select("image_id"), "image_id", "left_anti")


def product_components(edges: DataFrame) -> DataFrame:
    """(product_id, component): the least product_id of those that shared images reach."""
    some = edges.select("product_id", "image_id").distinct()
    # products of an image are joined to its least, so an image makes no pairs among them
    least = some.groupBy("image_id").agg(F.min("product_id").alias("least"))
    pairs = some.join(least, "image_id").select(F.col("product_id").alias("a"), F.col("least").alias("b"))
    found = connected_components(pairs)
    products = some.select("product_id").distinct()
    return products.join(found, products.product_id == found.node, "left").select("product_id", F.coalesce("component", "product_id").alias("component"))


def assign_splits(edges: DataFrame) -> DataFrame:
    """(product_id, component, split): all of a component go where its least product_id does."""
    return product_components(edges).withColumn("split", hash_split(F.col("component")))


def component_stats(assigned: DataFrame) -> DataFrame:
    """One row: products, components, largest_component, largest_component_share (4 places), singletons."""
    sizes = assigned.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("products"),
        F.count("*").alias("components"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest_component"),
        F.coalesce(F.round(F.try_divide(F.max("n").cast("double"), F.sum("n").cast("double")), 4), F.lit(0.0)).alias("largest_component_share"),
        F.count_if(F.col("n") == 1).alias("singletons"),
    )


def kept_types(rows: DataFrame, column: str, share: float = KEPT_SHARE) -> DataFrame:
    """Values whose cumulative share, most frequent first, is ``share`` at most; if none is, the most frequent."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    placed, whole = running(counts.withColumn("one", F.lit(1).cast("long")), [F.col("n").desc(), F.col(column).asc()], {"upto": "n", "place": "one"})
    shares = placed.withColumn("cumulative", F.col("upto") / F.lit(float(max(whole["upto"], 1))))
    # shares only rise, so if the first is too much, all are
    return shares.where((F.col("cumulative") <= share) | (F.col("place") == 1)).select(column, "n", "cumulative")


def long_tail(rows: DataFrame, column: str, kept: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of ``column`` if kept, else 'other'."""
    known = kept.select(F.col(column).alias("_kept"))
    return rows.join(known, rows[column] == known["_kept"], "left").withColumn(name, F.when(F.col("_kept").isNull(), "other").otherwise(F.col(column))).drop("_kept")


def straddling(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, n_splits) of keys in two splits or more; a leak if there is any."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where(F.col("n_splits") > 1)


def catalog_table(listings: DataFrame, splits: DataFrame, images: DataFrame, kept: DataFrame, generic: DataFrame) -> DataFrame:
    """Listings with a split and a main image that is known and not generic."""
    main = images.select(F.col("image_id").alias("main_image_id"), F.col("path").alias("main_image_path"), F.col("orig_width").alias("main_orig_width"), F.col("orig_height").alias("main_orig_height"))
    rows = listings.join(splits.select("product_id", "split"), "product_id").join(main, "main_image_id", "left")
    rows = long_tail(rows, "product_type_raw", kept, "product_type").where(F.col("main_image_path").isNotNull())
    rows = rows.join(generic.select(F.col("image_id").alias("main_image_id")), "main_image_id", "left_anti")
    return rows.select(
        "product_id",
        "product_type",
        "product_type_raw",
        "country",
        "marketplace",
        "title",
        "title_lang",
        "brand",
        "color",
        "split",
        "main_image_id",
        "main_image_path",
        "main_orig_width",
        "main_orig_height",
    )


def product_images_table(edges: DataFrame, splits: DataFrame, catalog: DataFrame) -> DataFrame:
    rows = edges.join(splits.select("product_id", "split"), "product_id").join(catalog.select("product_id"), "product_id", "left_semi")
    return rows.withColumn("plausible_product_photo", plausible_photo(F.col("orig_width"), F.col("orig_height"))).select(
        "product_id", "split", "image_id", "path", "orig_width", "orig_height", "is_main", "plausible_product_photo"
    )


def pairs_table(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("title").isNotNull()).select("product_id", "title", "title_lang", "product_type", "split", "main_image_id", "main_image_path")


def redundant_rows(rows: DataFrame, column: Column | str) -> DataFrame:
    """One row: rows less distinct values."""
    return rows.agg((F.count("*") - F.countDistinct(column)).alias("redundant"))
