"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined results: null, empty and wordless texts are scored as the classifiers say and stand for themselves as
near-duplicates; repeated rows are one after the third stage if they have words, and are all kept if not; rows are
judged by their own text, also where a doc_id is null or that of several; texts are read whole, however long; an
empty table passes as such; extra columns are kept, whatever their names, until the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import decontaminate, jaccard_join, packing, quality, toxicity
from shelfspark.llm.queries import table
from shelfspark.plans.cut import dropped, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.scorer()("text") >= quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.scorer()("text") < toxicity.THRESHOLD)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each component of near-duplicates."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also with other numbers, names or units."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_alike),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]
#: The classifiers, the tokenizer and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows lie as Parquet in the shared folder, those of the last stage only until its successor is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                dropped(spark, f"{folder}/{k - 1}")
    return docs
