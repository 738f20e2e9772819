"""Cutting lineage and numbering rows, without moving rows to the driver."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: monotonically_increasing_id(): the partition is above these bits, the row's place in it below.
ROW_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and Spark runs in one process."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shelfspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def bounded_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 4) -> None:
    """From now on rows go to Python in batches of at most so many rows and about so many bytes, however long texts are."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", megabytes << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key, str(most)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared checkpoint folder: lineage ends there and partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as written to Parquet in the shared folder, and where: narrower than a checkpoint, for ``dropped`` to delete."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what ``tabled`` wrote, once nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer referred to: it does so only when garbage is collected.

    For after steps that shuffle much, as their files would else stay until the driver's heap happens to fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list, name: str = "rank") -> tuple[DataFrame, int]:
    """Rows of ``df`` with their place (from 0, gapless) in the order of ``order``, and how many there are.

    A range sort deals the rows out, so a hot key may span partitions. Of each partition one number, its
    row count, comes to the driver. Ties in ``order`` are numbered as they lie.
    """
    spark = df.sparkSession
    out = cut(df.repartitionByRange(width(spark), *order).sortWithinPartitions(*order))
    here = F.monotonically_increasing_id()
    part = F.shiftright(here, ROW_BITS).cast("int")
    sizes = {r.p: r.n for r in out.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    if not total:
        return out.withColumn(name, F.lit(0).cast("long")), 0
    start = F.element_at(F.lit(starts).cast("array<long>"), part + 1)
    return out.withColumn(name, start + here.bitwiseAND((1 << ROW_BITS) - 1)), total


def running(df: DataFrame, order: list, sums: dict[str, str]) -> tuple[DataFrame, dict]:
    """``df`` with, for each name of ``sums``, that column's sum over all rows up to and with its own, and the sums of all.

    Rows are range-sorted by ``order``, which must tell them apart; sums are made within partitions, and of each
    partition its totals come to the driver. So no task meets all rows, as it would in a window without a key.
    """
    out = cut(df.repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order))
    here = F.monotonically_increasing_id()
    out = cut(out.withColumns({"_part": F.shiftright(here, ROW_BITS).cast("int"), "_row": here}))
    totals = {r["_part"]: r for r in out.groupBy("_part").agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect()}
    before: dict[str, list] = {n: [] for n in sums}
    whole = dict.fromkeys(sums, 0)
    for p in range(max(totals, default=-1) + 1):
        for n in sums:
            before[n].append(whole[n])
            whole[n] += (totals[p][n] or 0) if p in totals else 0
    upto = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        start = F.element_at(F.lit(before[n] or [0]), F.col("_part") + 1)
        out = out.withColumn(n, F.sum(c).over(upto) + start)
    return out.drop("_part", "_row"), whole
