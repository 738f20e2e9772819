"""Exact top-k search in binary codes by incremental multi-index hashing.

Vectors become codes of one bit for each sign, in words of 64 bits, as many as the dimensions need. A code's segments of 16
bits are indexed by value. A query probes each segment's values at distance 0, then 1, and so on; after radius r
every code at distance m (r + 1) - 1 or less, of m segments, has been met, as one of its segments is within r. A query
ends when its kth verified distance is that or less.

A pair is taken at its first segment of least distance, so no pair is taken twice and none is counted again. Equal codes
are one, with their number and their least ids: a code that a third of all rows have is one row of the index. The masks of
a radius are a small table; probes are dealt out before they are made.

Defined results: a null vector has no code and is neither query nor result; missing, null and NaN signs are 0, so a shorter
vector counts as one that ends in zeros. Rows of one id and one code are one. A query isn't its own
result; ties go to the lesser id; fewer than k other rows give fewer results. An empty table gives none. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.cut import cut, width as partitions

WORD, WIDTH = 64, 16


def sign_code(vector: Column, words: int) -> Column:
    """One bit for each positive element, in an array of ``words`` numbers of 64 bits."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def word(w: Column) -> Column:
        bits = F.transform(F.slice(vector, w * WORD + 1, WORD), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda a, b: a.bitwiseOR(b))

    return F.when(vector.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word))


def segment(code: Column, i: int) -> Column:
    per = WORD // WIDTH
    return F.shiftrightunsigned(code[i // per], WIDTH * (i % per)).bitwiseAND((1 << WIDTH) - 1).cast("int")


def apart(a: Column, b: Column, words: int) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(words)))


def _probes(queries: DataFrame, radius: int, segments: int) -> DataFrame:
    """(query, part, value) of every segment value at ``radius`` from each query's."""
    spark = queries.sparkSession
    masks = F.broadcast(spark.range(1 << WIDTH, numPartitions=1).where(F.bit_count("id") == radius).select(F.bit_count("id").alias("radius"), F.col("id").cast("int").alias("mask")))
    parts = F.array(*(F.struct(F.lit(i).alias("part"), segment(F.col("query"), i).alias("own")) for i in range(segments)))
    each = queries.select("query", F.explode(parts).alias("p")).select("query", "p.part", "p.own", F.lit(radius).alias("radius"))
    dealt = each.repartition(partitions(spark), "query", "part")
    return dealt.join(masks, "radius").select("query", "part", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))


def nearest(rows: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of each row for which ``queries`` (a condition on ``id``) holds.

    Returns query_id, rank from 1, the id and distance, in the order of distance and id.
    """
    longest = rows.agg(F.max(F.size(vector)).alias("n")).first().n or 0
    words = max(1, -(-longest // WORD))
    segments = max(1, -(-longest // WIDTH))
    items = cut(rows.select(F.col(id_column).alias("id"), sign_code(F.col(vector), words).alias("code")).where("id is not null and code is not null").distinct())
    codes = cut(items.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    index = cut(codes.select("code", "n", "least", F.explode(F.array(*(F.struct(F.lit(i).alias("part"), segment(F.col("code"), i).alias("value")) for i in range(segments)))).alias("s")).select("s.part", "s.value", "code", "n", "least"))
    asked = items.where(queries)
    # a query's own id may have several codes; so many more are looked for
    own = items.join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("m"))
    wanted = cut(asked.join(own, "id").groupBy(F.col("code").alias("query")).agg((F.max("m") + k).alias("need")))
    most = wanted.agg(F.max("need").alias("m")).first().m or 0
    found, active = None, wanted
    near = Window.partitionBy("query").orderBy("d", "least")
    for radius in range(WIDTH + 1):
        met = _probes(active, radius, segments).join(index, ["part", "value"]).join(active, "query")
        dists = [F.bit_count(segment(F.col("query"), i).bitwiseXOR(segment(F.col("code"), i))) for i in range(segments)]
        first = reduce(lambda a, b: a | b, ((F.col("part") == i) & reduce(lambda a, b: a & b, (dists[j] > radius if j < i else dists[j] >= radius for j in range(segments))) for i in range(segments)))
        new = met.where(first).select("query", "need", "code", "n", "least", apart(F.col("query"), F.col("code"), words).alias("d"))
        both = new if found is None else found.unionAll(new)
        found = cut(both.withColumn("r", F.row_number().over(near)).where((F.col("r") <= F.col("need")) & (F.col("r") <= most)).drop("r"))
        sure = found.where(F.col("d") <= segments * (radius + 1) - 1).groupBy("query").agg(F.sum("n").alias("n"))
        active = cut(wanted.join(sure, "query", "left").where(F.coalesce("n", F.lit(0)) < F.col("need")).select("query", "need"))
        if active.isEmpty():
            break
    of_code = Window.partitionBy("code").orderBy("id")
    ids = items.withColumn("r", F.row_number().over(of_code)).where(F.col("r") <= most).drop("r")
    pairs = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(found.select("query", "code", "d"), "query").join(ids, "code").where("id <> query_id")
    best = Window.partitionBy("query_id").orderBy("d", "id")
    nearest_code = pairs.groupBy("query_id", "id").agg(F.min("d").alias("d"))
    return nearest_code.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), F.col("d").alias("distance"))
