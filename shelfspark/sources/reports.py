"""Reports: JSON, Markdown and rank files."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: How model input is made, for those who read it elsewhere: fixed values.
PREPROCESS = {"image_size": 224, "resize_shortest": 224, "resample": "bicubic", "crop": "center", "layout": "CHW", "range": [0.0, 1.0], "alpha": "white"}


def write_whole(spark: SparkSession, path: str, data: bytes) -> None:
    """One file at ``path`` on any Hadoop file system, written beside it and then moved there, so that it is never seen in part."""
    context = spark.sparkContext
    place, own = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(own, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    system.delete(place, False)
    if not system.rename(own, place):
        raise OSError(f"{own} could not be moved to {path}")


def relation(spark: SparkSession, frame: pd.DataFrame, name: str) -> DataFrame:
    """A frame in memory as a view of that name, for SQL; a later one replaces it."""
    rows = spark.createDataFrame(frame)
    rows.createOrReplaceTempView(name)
    return rows


def write_json(row: DataFrame, path: str) -> dict:
    """One row as a JSON file; its values."""
    row.coalesce(1).write.mode("overwrite").json(path)
    return row.first().asDict(recursive=True)


def write_preprocess(spark: SparkSession, path: str) -> None:
    """The preprocessing settings as one line of JSON."""
    spark.createDataFrame([(json.dumps(PREPROCESS, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """(system, query_id, rank) as JSON lines, a folder a system."""
    ranks.write.mode("overwrite").partitionBy("system").json(path)


def table(headers: list[str], rows: list[list]) -> str:
    spell = lambda x: f"{x:.4f}" if isinstance(x, float) else "" if x is None else str(x)
    lines = [headers, ["---"] * len(headers), *([spell(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def data_card(report: dict, splits: DataFrame) -> str:
    """What a catalog build made, in Markdown."""
    body = [f"# Catalog\n\nBuilt from {report.get('listings_total', 0):,} listings.\n", table(["figure", "value"], [[k, v] for k, v in sorted(report.items())])]
    columns = splits.columns
    return "\n".join([*body, "## Splits\n", table(columns, [list(r) for r in splits.orderBy(columns[0]).collect()])])


def retrieval_report(summaries: DataFrame, deltas: list[dict], meta: dict) -> str:
    """Metrics of each system and differences with their intervals, in Markdown."""
    columns = summaries.columns
    parts = [f"# Retrieval\n\n{json.dumps(meta, sort_keys=True)}\n", table(columns, [list(r) for r in summaries.orderBy(columns[0]).collect()])]
    if deltas:
        names = list(deltas[0])
        parts += ["## Differences\n", table(names, [[d[n] for n in names] for d in deltas])]
    return "\n".join(parts)


def calibration_report(methods: dict[str, dict], floor: float) -> str:
    names = sorted({k for m in methods.values() for k in m})
    return f"# Calibration\n\nLeast precision {floor}.\n\n" + table(["method", *names], [[m, *(methods[m].get(n) for n in names)] for m in sorted(methods)])


def with_threshold(thresholds: dict, methods: dict[str, dict]) -> dict:
    """``thresholds`` with the cutoffs found; unchanged if no method has one. The best by F1 on held-out pairs is selected."""
    found = {n: m for n, m in methods.items() if m.get("threshold") is not None and n in thresholds["methods"]}
    if not found:
        return thresholds
    best = max(sorted(found), key=lambda n: found[n].get("held_f1") or 0.0)
    known = {n: c | {"max_distance": found[n]["threshold"] if n == best else None} for n, c in thresholds["methods"].items()}
    return thresholds | {"calibrated": True, "selected_method": best, "methods": known}
