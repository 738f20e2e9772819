"""Tar shards: reading members and samples, writing planned samples, checking what was written."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import title_hash

ROLES, SPLITS = ("pairs", "index"), ("train", "val", "test")
SIDECAR = "product_id string, image_id string, path string, split string"


def tar_members(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(archive, name, data) of each file member of the tars at ``path`` whose name has ``prefix``. A tar is one row to Spark, so of 2 GiB at most; larger ones are to be split first."""
    tars = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with tarfile.open(fileobj=io.BytesIO(row.content)) as tar:
                    for member in tar:
                        if member.isfile() and member.name.startswith(prefix):
                            yield pd.DataFrame({"archive": [row.path], "name": [member.name], "data": [tar.extractfile(member).read()]})

    return tars.mapInPandas(run, "archive string, name string, data binary")


def shard_paths(spark: SparkSession, folder: str, role: str = "pairs", split: str = "train") -> list[str]:
    """Sorted paths of a series; names of roles and splits are checked, and an empty series is an error."""
    if role not in ROLES or split not in SPLITS:
        raise ValueError(f"no series {role}-{split}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{role}-{split}-*.tar").load(folder)
    found = sorted(r.path for r in files.select("path").collect())
    if not found:
        raise FileNotFoundError(f"no {role}-{split} shards in {folder}")
    return found


def samples(spark: SparkSession, folder: str, role: str = "pairs", split: str = "train", seed: int | None = None) -> DataFrame:
    """Samples of a series: key, product_id, product_hash, title, title_hash, image, split; 0 is no hash.

    Members of one key are a sample; one without an image or with a broken sidecar is left out. With ``seed`` they
    are in an order drawn by it, else in that of keys.
    """
    members = tar_members(spark, folder + f"/{role}-{split}-*.tar")
    parts = members.select("archive", F.regexp_extract("name", r"^(?:.*/)?([^/.]+)\.[^/]*$", 1).alias("key"), F.lower(F.regexp_extract("name", r"\.([^/.]+)$", 1)).alias("kind"), "data")
    text = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("data").cast("string")))
    rows = parts.groupBy("archive", "key").agg(F.max(F.when(F.col("kind").isin("jpg", "jpeg", "png", "raw"), F.col("data"))).alias("image"), text("json").alias("json"), text("txt").alias("title"))
    rows = rows.withColumn("meta", F.from_json("json", SIDECAR)).where("image is not null and meta is not null")
    product = F.coalesce("meta.product_id", F.lit(""))
    out = rows.select("key", product.alias("product_id"), title_hash(product).alias("product_hash"), F.coalesce("title", F.lit("")).alias("title"), title_hash(F.coalesce("title", F.lit(""))).alias("title_hash"), "image", "meta.split")
    return out.orderBy("key") if seed is None else out.orderBy(F.xxhash64(F.lit(seed), "key"), "key")


def first(rows: DataFrame, n: int) -> DataFrame:
    return rows.limit(n)


def tar_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """A USTAR archive with fixed headers, so equal members give equal bytes."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), 0o644
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def packed(rows: DataFrame) -> DataFrame:
    """Archives of planned samples: role, split, shard, name, samples, bytes, payload_bytes, sha256, archive.

    ``rows``: role, split, shard (from ``planning.rolled``), key, suffix, data, meta (JSON), title (nullable), in the order
    of path and key. A shard is bounded by its budget and made in one task.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["path", "key"])
        members, payload = [], 0
        for row in group.itertuples():
            parts = [(row.suffix, bytes(row.data)), (".json", json.dumps(json.loads(row.meta), sort_keys=True).encode())]
            if row.title is not None and row.title == row.title:
                parts.append((".txt", row.title.encode()))
            members += [(f"{row.role}/{row.key}{suffix}", data) for suffix, data in parts]
            payload += sum(len(data) for _, data in parts)
        role, split, shard = (group[c].iloc[0] for c in ("role", "split", "shard"))
        archive = tar_bytes(members)
        made = {"name": f"{role}-{split}-{shard:06d}.tar", "samples": len(group), "bytes": len(archive), "payload_bytes": payload, "sha256": hashlib.sha256(archive).hexdigest(), "archive": archive}
        return pd.DataFrame([{"role": role, "split": split, "shard": shard} | made])

    return rows.groupBy("role", "split", "shard").applyInPandas(one, "role string, split string, shard int, name string, samples long, bytes long, payload_bytes long, sha256 string, archive binary")


def write_archives(archives: DataFrame, folder: str) -> int:
    """Writes each archive as a file in ``folder``, a URI or path that executors share, from the task that holds it; returns their number.

    A file is written under a name of its own and then moved, so none is ever seen in part and a task may run again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples():
                system, place = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                system.create_dir(place)
                own = f"{place}/.{row.name}-{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(row.archive)
                system.move(own, f"{place}/{row.name}")
            yield pd.DataFrame({"n": [len(batch)]})

    return archives.select("name", "archive").mapInPandas(write, "n long").agg(F.sum("n").alias("n")).first().n or 0


def manifest(archives: DataFrame, most: int = 500) -> dict:
    """Counts and checksums of each series; an error if there are more shards than ``most``."""
    rows = archives.select("role", "split", "name", "samples", "bytes", "payload_bytes", "sha256").orderBy("name").collect()
    if len(rows) > most:
        raise ValueError(f"{len(rows)} shards, more than {most}")
    series: dict[str, dict] = {}
    for r in rows:
        s = series.setdefault(f"{r.role}-{r.split}", {"samples": 0, "bytes": 0, "payload_bytes": 0, "shards": []})
        for k in ("samples", "bytes", "payload_bytes"):
            s[k] += r[k]
        s["shards"].append({"name": r.name, "samples": r.samples, "bytes": r.bytes, "sha256": r.sha256})
    return {"series": series, "shard_count": len(rows)}


def save_embeddings(rows: DataFrame, path: str, meta: dict) -> None:
    """(key, vector) as Parquet in half precision, each row with what encoded it; a null, and vectors of two lengths, are errors."""
    found = rows.agg(F.count_if(F.col("vector").isNull() | F.col("key").isNull()).alias("missing"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if found.missing:
        raise ValueError("a key or vector is missing")
    if found.least != found.most:
        raise ValueError(f"vectors of {found.least} to {found.most} numbers")

    @F.pandas_udf("binary")
    def halves(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, dtype="<f2").tobytes())

    rows.select("key", halves(F.col("vector").cast("array<float>")).alias("vector"), F.lit(json.dumps(meta, sort_keys=True)).alias("meta")).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key, vector) of several splits; a missing one and a key in two of them are errors."""
    rows = spark.read.parquet(*paths)
    twice = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"keys in more than one place: {[r.key for r in twice]}")

    @F.pandas_udf("array<float>")
    def singles(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.frombuffer(v, dtype="<f2").astype(np.float32))

    return rows.select("key", singles("vector").alias("vector"))
