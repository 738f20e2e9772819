"""An audit of sets of images: measurements, verdicts, duplicates, mismatches, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import audit, dedup, pixels
from ..operators.rules import RULES
from .cut import cut


def run(images: DataFrame, main: DataFrame | None = None, rules: dict = RULES, thresholds: dict = dedup.THRESHOLDS) -> dict[str, DataFrame]:
    """checks, payloads, pairs, mismatches and rejected of ``images``: set_id, idx, image_id, width, height, n_channels, data, format, tag.

    ``main``: set_id, main_index; a set without a row has no main image named. Images that can't be measured are told in
    ``rejected`` with a reason; they count among a set's images. An image may be in several sets.
    """
    found = pixels.measured(images).join(pixels.hashed(images), "image_id")
    rows = images.select("set_id", "idx", "image_id", "width", "height", "format", "tag").join(found, "image_id")
    rows = rows.join(main, "set_id", "left") if main is not None else rows.withColumn("main_index", F.lit(None).cast("long"))
    rows = cut(rows.withColumn("is_main", audit.main_flag(F.col("idx"), F.col("main_index"))))
    checked = cut(audit.checks(rows.drop("main_index"), rules))
    supplied = images.groupBy("set_id").agg(F.count("*").alias("n_images"))
    # duplicates and mismatches are told within a set
    report = dedup.near_duplicates(rows.select(F.struct("set_id", "idx").alias("idx"), "dhash", "phash", "tiles", "detail_std"), thresholds)
    pairs = report["pairs"].where("a.set_id = b.set_id")
    clusters = dedup.clusters(pairs).select("idx.set_id", F.col("cluster.idx").alias("cluster"), F.col("idx.idx").alias("idx"))
    most = report["threshold"]
    mismatches = None
    if most is not None:
        tagged = rows.where("tag is not null").select("set_id", F.struct("set_id", "idx").alias("idx"), F.col(report["method"]).alias("hash"), "tag", "detail_std")
        mismatches = dedup.group_mismatches(tagged, most, within=("set_id",)).select("idx.set_id", F.col("idx.idx").alias("idx"), "own", "nearest")
    return {"checks": checked, "pairs": pairs, "mismatches": mismatches, "rejected": pixels.rejected(images), "payloads": audit.payloads(checked, supplied, rules, clusters, mismatches)}
