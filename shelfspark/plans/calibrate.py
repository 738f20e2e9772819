"""Calibration of distances on a labelled set of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import hamming
from ..operators import calibration, dedup
from .cut import cut


def scored(pairs: DataFrame, features: DataFrame, per_tile: int = dedup.THRESHOLDS["methods"]["tiles"]["per_tile_max_bits"], seed: int = 0) -> DataFrame:
    """``pairs`` with the distance of each method and of two floors: drawn by hash, and of 32 x 32 pixels if ``features`` has them."""
    cols = [c for c in features.columns if c != "name"]
    a = features.select(F.col("name").alias("a"), *(F.col(c).alias(f"a_{c}") for c in cols))
    b = features.select(F.col("name").alias("b"), *(F.col(c).alias(f"b_{c}") for c in cols))
    rows = pairs.join(a, "a").join(b, "b")
    out = [hamming(F.col(f"a_{m}"), F.col(f"b_{m}")).cast("double").alias(m) for m in ("dhash", "phash")]
    out.append(dedup.tile_distance(F.col("a_tiles"), F.col("b_tiles"), per_tile).cast("double").alias("tiles"))
    out.append((F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(1_000_003)) / 1_000_003.0).alias("random"))
    if "thumb" in cols:
        out.append(calibration.mean_squared(F.col("a_thumb"), F.col("b_thumb")).alias("mse"))
    return rows.select(*pairs.columns, *out)


def dev_asins(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """Half of the asins, in an order drawn by ``seed``."""
    names = [r.asin for r in pairs.select("asin").distinct().orderBy(F.xxhash64(F.lit(seed), "asin"), "asin").collect()]
    return pairs.sparkSession.createDataFrame([(n,) for n in names[: len(names) // 2]], "asin string")


def calibrate(pairs: DataFrame, floor: float = calibration.PRECISION_FLOOR, seed: int = 0) -> dict[str, dict]:
    """Of each method: AUC over all, against hard negatives, and on held-out pairs; the threshold and its figures."""
    rows = cut(pairs)
    dev = dev_asins(rows, seed)
    chosen, held = rows.join(dev, "asin", "left_semi"), rows.join(dev, "asin", "left_anti")
    hard = rows.where("label = 1 or kind = 'hard_negative'")
    out = {}
    for method in [c for c in ("dhash", "phash", "tiles", "random", "mse") if c in rows.columns]:
        auc = lambda some: calibration.roc_auc(some, F.col(method), F.col("label")).first().auc  # noqa: B023, E731
        entry = {"auc_all": auc(rows), "auc_held": auc(held), "auc_hard": auc(hard), "threshold": None}
        best = calibration.best_threshold(calibration.sweep(chosen, F.col(method), F.col("label")), floor).first()
        if best:
            t = best.threshold
            tp, fp, fn = F.count_if((F.col(method) <= t) & (F.col("label") == 1)), F.count_if((F.col(method) <= t) & (F.col("label") == 0)), F.count_if((F.col(method) > t) & (F.col("label") == 1))
            entry |= {"threshold": t, "dev_f1": best.f1}
            for name, some in (("held", held), ("held_hard", held.where("label = 1 or kind = 'hard_negative'")), ("held_easy", held.where("label = 1 or kind = 'easy_negative'"))):
                counts = some.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
                precision, recall, f1 = calibration.prf(F.col("tp"), F.col("fp"), F.col("fn"))
                entry |= {f"{name}_{k}": v for k, v in counts.select(precision.alias("precision"), recall.alias("recall"), f1.alias("f1")).first().asDict().items()}
            positive = rows.where("label = 1").select("kind", F.col(method).alias("distance"))
            entry["per_mutation"] = {r.kind: r.recall for r in calibration.recall_by_kind(positive, t).collect()}
        out[method] = entry
    return out
