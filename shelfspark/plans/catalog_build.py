"""The catalog from listings and image metadata: tables, report, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog
from ..sources import listings as source
from .cut import cut


class Leak(AssertionError):
    """Something is in two splits."""


def build(spark: SparkSession, listings_path: str, images_path: str, cap: int = catalog.GENERIC_CAP, subset: int | None = None) -> dict[str, DataFrame | dict]:
    """catalog, product_images, pairs, and report. Invariants are checked before anything can be written."""
    raw = source.raw_listings(spark, listings_path)
    rows = cut(source.listings(raw, subset))
    images = cut(source.image_metadata(spark, images_path))
    every = cut(catalog.with_images(catalog.edges_of(rows), images))
    generic = cut(catalog.generic_images(every, cap))
    edges = cut(catalog.prune(every, generic))
    splits = cut(catalog.assign_splits(edges))
    kept = cut(catalog.kept_types(rows, "product_type_raw"))
    table = cut(catalog.catalog_table(rows, splits, images, kept, generic))
    product_images = cut(catalog.product_images_table(edges, splits, table))
    pairs = catalog.pairs_table(table)
    check(table, product_images)
    per_product = product_images.groupBy("product_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 2).alias("n")).first().n
    report = source.listing_counts(raw).first().asDict() | {f"component_{k}": v for k, v in catalog.component_stats(splits).first().asDict().items()}
    report |= {
        "catalog": table.count(),
        "product_images": product_images.count(),
        "pairs": pairs.count(),
        "product_types_kept": kept.count(),
        "generic_images_dropped": generic.count(),
        "generic_image_edges_dropped": every.count() - edges.count(),
        "implausible_aspect_images": product_images.where("not plausible_product_photo").count(),
        "images_per_product": float(per_product or 0),
        "title_langs": {r.title_lang: r["count"] for r in pairs.groupBy("title_lang").count().orderBy(F.col("count").desc(), "title_lang").collect()},
        "splits": {r.split: r["count"] for r in table.groupBy("split").count().collect()},
    }
    return {"catalog": table, "product_images": product_images, "pairs": pairs, "report": report}


def check(table: DataFrame, product_images: DataFrame) -> None:
    """Raises ``Leak`` if a product, an image or a main image is in two splits."""
    for name, rows, key in (("product", table, "product_id"), ("image", product_images, "image_id"), ("main image", table, "main_image_id")):
        found = catalog.straddling(rows, key).limit(5).collect()
        if found:
            raise Leak(f"{name} in more than one split: {[r[0] for r in found]}")


def write(built: dict, folder: str) -> None:
    for name in ("catalog", "product_images", "pairs"):
        built[name].write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
