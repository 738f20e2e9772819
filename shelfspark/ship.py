"""Gives executors this package where they can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once a context, unless PYTHONPATH names the package's folder: the driver serves its sources to executors."""
    context = spark.sparkContext
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_shelfspark", False):
        return
    packed = Path(tempfile.mkdtemp(prefix="shelfspark-")) / "shelfspark.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for source in sorted(ROOT.rglob("*.py")):
            out.write(source, source.relative_to(ROOT.parent))
    context.addPyFile(str(packed))
    context._shelfspark = True


def shipped(f: Callable) -> Callable:
    """``f``, a query, that ships the package first."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return f(spark, sf_dir)

    return run
