"""Calibration of a distance: labelled pairs, ROC-AUC, precision and recall over thresholds, the best threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import double
from ..plans.cut import running

#: The least precision on the development pairs: a fixed value.
PRECISION_FLOOR = 0.95


def labeled_pairs(images: DataFrame) -> DataFrame:
    """(a, b, label, kind, asin) from ``images`` (name, source, mutation, asin; sources have no mutation).

    Positive: a mutant and its source. Hard negative: two sources of one asin, or a mutant and another source of its
    asin. Easy negative: sources of two asins.
    """
    source = images.where("mutation is null").select("name", "asin")
    mutant = images.where("mutation is not null").select("name", "asin", "source", "mutation")
    positive = mutant.select(F.col("source").alias("a"), F.col("name").alias("b"), F.lit(1).alias("label"), F.concat(F.lit("positive::"), "mutation").alias("kind"), "asin")
    x, y = source.select(F.col("name").alias("a"), F.col("asin")), source.select(F.col("name").alias("b"), F.col("asin"))
    hard = x.join(y, "asin").where("a < b")
    other = mutant.select(F.col("name").alias("b"), "asin", "source").join(x, "asin").where("a <> source").select("asin", "a", "b")
    negative = hard.select("asin", "a", "b").unionByName(other).select("a", "b", F.lit(0).alias("label"), F.lit("hard_negative").alias("kind"), "asin")
    # a small labelled set: all pairs of sources are its definition
    easy = x.join(y.select("b", F.col("asin").alias("other")), F.col("asin") < F.col("other")).select("a", "b", F.lit(0).alias("label"), F.lit("easy_negative").alias("kind"), "asin")
    return positive.unionByName(negative).unionByName(easy)


def roc_auc(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row, auc: the Mann-Whitney statistic, lower scores being more positive, ties sharing their mean rank; NaN if a class is empty.

    Counts by distinct score are summed up along the order, not rows.
    """
    counts = rows.select(score.alias("s"), label.alias("y")).groupBy("s").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("q"))
    placed, _ = running(counts, [F.col("s").desc()], {"upto": "q"})
    u = placed.withColumn("u", F.col("p") * (F.col("upto") - F.col("q") / double(2))).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return u.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).otherwise(double("nan")).alias("auc"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), double(0))
    precision, recall = safe(tp, tp + fp), safe(tp, tp + fn)
    return precision, recall, safe(double(2) * precision * recall, precision + recall)


def sweep(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """For each distinct score as threshold (accepting that much or less): tp, fp, fn, precision, recall, f1."""
    counts = rows.select(score.alias("threshold"), label.alias("y")).groupBy("threshold").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("q"))
    summed, whole = running(counts, ["threshold"], {"tp": "p", "fp": "q"})
    out = summed.withColumn("fn", F.lit(whole["tp"]).cast("long") - F.col("tp"))
    precision, recall, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("threshold", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def best_threshold(swept: DataFrame, floor: float = PRECISION_FLOOR) -> DataFrame:
    """The row of greatest F1 among those of enough precision, the least threshold on ties; none if none is precise enough."""
    return swept.where(F.col("precision") >= floor).orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)


def recall_by_kind(rows: DataFrame, threshold: float) -> DataFrame:
    """(kind, n, caught, recall, median_distance) of positive pairs ``rows`` (kind, distance)."""
    caught = F.count_if(F.col("distance") <= threshold)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), caught.alias("caught"), (caught / F.count("*").cast("double")).alias("recall"), F.expr("percentile(distance, 0.5D)").alias("median_distance"))


def mean_squared(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of pixels."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), double(0), lambda s, x: s + x) / F.size(a)
