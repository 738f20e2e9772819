"""Images as tables of pixels: from Spark's image source or raw rows, with what the audit needs of the file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.web import sniff
from ..operators.rules import RULES

#: Names of formats by type: fixed values.
FORMATS = {"image/jpeg": "JPEG", "image/png": "PNG", "image/gif": "GIF", "image/tiff": "TIFF", "image/webp": "WEBP"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the path), content, n_bytes, sha256, format and reason (why it is not decoded; null: it is)."""
    rows = spark.read.format("binaryFile").load(path)
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), sniff(F.col("content")))
    reason = F.when(F.col("length") > RULES["decode"]["max_bytes"], "too many bytes").when(sniff(F.col("content")).isNull(), "no image")
    return rows.select(F.col("path").alias("image_id"), "content", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.when(sniff(F.col("content")).isNotNull(), kind).alias("format"), reason.alias("reason"))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """image_id, width, height, n_channels and data (RGB) of the images at ``path`` that can be read, within the pixel cap."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    rows = rows.where(F.col("width").cast("long") * F.col("height") <= RULES["decode"]["max_pixels"])
    return rgb(rows.select(F.col("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("n_channels"), "data"))


def rgb(rows: DataFrame) -> DataFrame:
    """Blue-green-red bytes, as the source gives, put in the order of red, green, blue (and alpha)."""

    @F.pandas_udf("binary")
    def turned(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(raw: bytes, n: int) -> bytes:
            if n < 3:
                return bytes(raw)
            a = np.frombuffer(raw, np.uint8).reshape(-1, n)
            return np.concatenate([a[:, 2::-1], a[:, 3:]], axis=1).tobytes()

        return pd.Series([one(d, n) for d, n in zip(data, channels, strict=True)])

    return rows.withColumn("data", turned("data", "n_channels"))


def manifest_images(manifest: DataFrame, features: DataFrame) -> DataFrame:
    """A labelled set's images (name, source, mutation, asin) with their features, hashed once a name."""
    return manifest.join(features.dropDuplicates(["name"]), "name")
