"""Structured Streaming over the same operators. An addition of this engine: nothing here has a batch counterpart to match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit
from ..operators.rules import RULES


def fresh(stream: DataFrame, time: str = "at", content: str = "content", delay: str = "1 hour") -> DataFrame:
    """A stream of images without those of a content seen within ``delay``."""
    return stream.withColumn("sha256", F.sha2(content, 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def counted(stream: DataFrame, time: str, kind: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Rows of each kind in each window of event time."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select("window.start", kind, "n")


def audited(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rules: dict = RULES) -> StreamingQuery:
    """Verdicts of each micro-batch of measured images, handed to ``sink``; ends when what is there is read."""
    return stream.writeStream.foreachBatch(lambda batch, i: sink(audit.checks(batch, rules), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
