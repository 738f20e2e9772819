"""Shards from a catalog: plan, invariants, archives, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import planning
from ..sources import shards
from .cut import cut


def plan(catalog: DataFrame, product_images: DataFrame, pairs: DataFrame, roles: tuple[str, ...] = ("pairs", "index"), subset: int | None = None) -> DataFrame:
    """role, split, key, path, title, meta (JSON) of each sample. Images of pairs are never in the index, whatever the roles."""
    fit = cut(planning.packable(product_images))
    paired = cut(planning.pairs_plan(pairs, fit, subset))
    fields = ["product_id", "image_id", "path", "split", "title", "title_lang", "product_type", "orig_width", "orig_height"]
    out = paired.select("role", "split", "key", "path", "title", F.to_json(F.struct(*fields, F.lit(True).alias("is_main"))).alias("meta"))
    if "index" in roles:
        rest = planning.index_plan(fit, product_images, catalog, paired, subset)
        rest = rest.select("role", "split", "key", "path", F.lit(None).cast("string").alias("title"), F.to_json(F.struct("image_id", "path", "split", "orig_width", "orig_height", "products")).alias("meta"))
        out = out.unionByName(rest) if "pairs" in roles else rest
    return out


def check(planned: DataFrame) -> dict:
    """Raises if a path is in two splits or a key is used twice; counts otherwise."""
    for name, found in (("paths in two splits", planning.straddling_paths(planned)), ("keys used twice", planning.duplicate_keys(planned))):
        some = found.limit(5).collect()
        if some:
            raise ValueError(f"{name}: {[tuple(r) for r in some]}")
    return planned.agg(F.countDistinct("path").alias("planned_paths"), F.count("*").alias("planned_samples")).first().asDict()


def pack(planned: DataFrame, members: DataFrame, budget: int, prefix: str = "images/small/") -> DataFrame:
    """Archives. A member (name, data) that several samples use goes to each; a planned path without one is an error."""
    seen = members.select(F.expr(f"substring(name, {len(prefix) + 1})").alias("path"), "data")
    absent = [r.path for r in planning.missing_members(planned, seen).limit(5).collect()]
    if absent:
        raise ValueError(f"planned images that the archive lacks: {absent}")
    rows = planned.join(seen, "path").withColumn("suffix", F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = rows.withColumn("n_bytes", 1536 + F.octet_length("data") + F.octet_length("meta") + F.coalesce(F.octet_length("title"), F.lit(0)))
    return shards.packed(planning.rolled(rows, budget))
