"""Retrieval evaluation of several systems over one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import retrieval
from .cut import cut

METRICS = ("recall_1", "recall_10", "recall_50", "ndcg_10", "rr")


def evaluate(corpus: DataFrame, queries: DataFrame, model: str = "vectors", seed: int = 0, resamples: int = 10_000) -> dict:
    """ranks (system, query_id, rank), summary, and deltas of ``model`` against each baseline.

    ``corpus``: id, vector, text, type. ``queries``: query_id, vector, text, target; a null text is empty.
    """
    asked = queries.withColumn("text", F.coalesce("text", F.lit("")))
    place = retrieval.prior_ranks(corpus, F.sha1(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")))
    n = corpus.count()
    systems = {
        model: retrieval.vector_ranks(corpus, asked),
        "bm25": retrieval.bm25_ranks(corpus, asked),
        "class_prior": asked.join(place.withColumnRenamed("id", "target"), "target").select("query_id", "rank"),
        "random": retrieval.random_ranks(asked, n, seed),
    }
    ranks = None
    for name, found in systems.items():
        some = found.select(F.lit(name).alias("system"), "query_id", F.col("rank").cast("long").alias("rank"))
        ranks = some if ranks is None else ranks.unionByName(some)
    ranks = cut(ranks)
    each = retrieval.per_query(ranks)
    deltas = []
    for other in [s for s in systems if s != model]:
        for metric in METRICS:
            both = each.where(F.col("system").isin(model, other)).groupBy("query_id").agg(F.sum(F.when(F.col("system") == model, F.col(metric)).otherwise(-F.col(metric))).alias("difference"))
            found = retrieval.paired_bootstrap(both.select("difference", "query_id"), resamples=resamples, seed=seed).first()
            deltas.append({"baseline": other, "metric": metric} | found.asDict())
    return {"ranks": ranks, "summary": retrieval.summary(ranks, "system"), "deltas": deltas, "corpus": n}
