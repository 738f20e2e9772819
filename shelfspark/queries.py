"""Queries over the supplied tables: one for each operator, over whole tables, with its SQL where SQL can express it.

A product is an order, an image a part, an edge a line item; the main image is that of the least line number. As parts
are on some 30 orders, the cap of generic images is 20 here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import scalars, web
from .operators import audit, calibration, catalog, dedup, pixels, planning, retrieval, training
from .operators.rules import RULES

CAP = 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Catalog ------------------------------------------------------------------------------------------------------

_EDGES = """edges as (
    select l_orderkey as product_id, l_partkey as image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) = 1 as is_main
    from lineitem)"""
_PRUNED = f"""{_EDGES},
generic as (select image_id, count(distinct product_id) as n_products from edges group by image_id having count(distinct product_id) > {CAP}),
pruned as (select * from edges where image_id not in (select image_id from generic))"""
_SPLIT = """case when k < 8 then 'train' when k = 8 then 'val' else 'test' end"""
_MOD = "cast((('0x' || substr(sha1({x}), 1, 10))::bigint * 6 + ('0x' || substr(sha1({x}), 11, 10))::bigint * 6 + ('0x' || substr(sha1({x}), 21, 10))::bigint * 6 + ('0x' || substr(sha1({x}), 31, 10))::bigint) % 10 as int)"
_COMPONENTS = f"""{_PRUNED},
least as (select image_id, min(product_id) as p from pruned group by image_id),
hops as (select distinct pruned.product_id as a, least.p as b from pruned join least using (image_id)),
both_ways as (select a, b from hops union select b, a from hops),
reach(p, q) as (select distinct product_id, product_id from pruned union select r.p, e.b from reach r join both_ways e on r.q = e.a),
components as (select p as product_id, min(q) as component from reach group by p),
assigned as (select product_id, component, {_SPLIT} as split from (select *, {_MOD.format(x="cast(component as varchar)")} as k from components))"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("product_id")).agg(lines.alias("lines"))
    ids = F.transform("lines", lambda x: x["l_partkey"])
    return rows.select("product_id", F.get(ids, F.lit(0)).alias("main_image_id"), F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))).alias("other_image_ids"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.edges_of(listings(spark, sf_dir))


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = edges(spark, sf_dir)
    return catalog.prune(some, catalog.generic_images(some, CAP))


@query(f"with {_EDGES} select * from edges")
def edge_build(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"with {_PRUNED} select * from generic")
def generic_nodes(spark, sf_dir):
    return catalog.generic_images(edges(spark, sf_dir), CAP)


@query(f"with {_PRUNED} select * from pruned")
def generic_prune(spark, sf_dir):
    return pruned(spark, sf_dir).select("product_id", "image_id", "is_main")


@query(f"with recursive {_COMPONENTS} select * from assigned")
def component_split(spark, sf_dir):
    return catalog.assign_splits(pruned(spark, sf_dir))


@query(f"""with recursive {_COMPONENTS}, sizes as (select component, count(*) as n from components group by component)
select cast(coalesce(sum(n), 0) as bigint) as products, count(*) as components, coalesce(max(n), 0) as largest_component,
    coalesce(round(max(n) / cast(sum(n) as double), 4), 0) as largest_component_share, count(*) filter (n = 1) as singletons from sizes""")
def component_stats(spark, sf_dir):
    return catalog.component_stats(catalog.product_components(pruned(spark, sf_dir)))


@query(f"""with recursive {_COMPONENTS}, by_product as (select *, {_SPLIT} as own from (select *, {_MOD.format(x="cast(product_id as varchar)")} as k from pruned)),
a as (select image_id from by_product group by image_id having count(distinct own) > 1),
b as (select image_id from pruned join assigned using (product_id) group by image_id having count(distinct split) > 1)
select 'product' as split_by, (select count(*) from a) as leaked_images union all select 'component', (select count(*) from b)""")
def leak_images(spark, sf_dir):
    some = pruned(spark, sf_dir)
    naive = some.withColumn("split", scalars.hash_split(F.col("product_id")))
    safe = some.join(catalog.assign_splits(some).select("product_id", "split"), "product_id")
    count = lambda rows, name: catalog.straddling(rows, "image_id").agg(F.count("*").alias("leaked_images")).select(F.lit(name).alias("split_by"), "leaked_images")
    return count(naive, "product").unionByName(count(safe, "component"))


@query(f"""with recursive {_COMPONENTS} select product_id, count(distinct split) as n_splits from assigned group by product_id having count(distinct split) > 1""")
def leak_products(spark, sf_dir):
    return catalog.straddling(catalog.assign_splits(pruned(spark, sf_dir)), "product_id")


@query(f"select doc_id, {_SPLIT} as split from (select doc_id, {_MOD.format(x='cast(doc_id as varchar)')} as k from documents)")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.hash_split(F.col("doc_id")).alias("split"))


_KEPT = """counts as (select p_type, count(*) as n from lineitem join part on p_partkey = l_partkey group by p_type),
    shares as (select p_type, n, sum(n) over (order by n desc, p_type) / cast(sum(n) over () as double) as cumulative, row_number() over (order by n desc, p_type) as place from counts),
    kept as (select p_type, n, cumulative from shares where cumulative <= 0.9 or (place = 1 and not exists (select 1 from shares where cumulative <= 0.9)))"""


@query(f"with {_KEPT} select * from kept")
def kept_types(spark, sf_dir):
    return catalog.kept_types(_typed(spark, sf_dir), "p_type")


@query(f"with {_KEPT} select coalesce(kept.p_type, 'other') as product_type, count(*) as n, sum(l_quantity) as quantity from lineitem join part on p_partkey = l_partkey left join kept using (p_type) group by 1")
def long_tail_bucket(spark, sf_dir):
    rows = _typed(spark, sf_dir)
    return catalog.long_tail(rows, "p_type", catalog.kept_types(rows, "p_type"), "product_type").groupBy("product_type").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def _typed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))


@query("""with firsts as (select source, lang, min(doc_id) as doc_id from documents where text <> '' group by source, lang),
r as (select source, text, lang, row_number() over (partition by source order by list_position(['es', 'de', 'en'], lang)) as k from firsts join documents using (source, lang, doc_id) where lang in ('es', 'de', 'en'))
select source, md5(r.text) as value, r.lang as tag from (select distinct source from documents) left join r using (source) where coalesce(k, 1) = 1""")
def localized_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    firsts = docs.where("text <> ''").groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("text"))  # the first of each tag, so that entries stay few
    entries = firsts.groupBy("source").agg(F.collect_list(F.struct(F.col("lang").alias("language_tag"), F.col("text").alias("value"))).alias("entries"))
    picked = docs.select("source").distinct().join(entries, "source", "left").withColumn("p", scalars.localized_pick(F.col("entries"), ("es", "de", "en")))
    return picked.select("source", F.md5(F.col("p.value").cast("binary")).alias("value"), F.col("p.tag").alias("tag"))


@query("select p_partkey, coalesce(p_size * 40.0::double / nullif(p_retailprice, 0) between 0.25 and 4.0, false) as plausible, p_size * 40 >= 700 and p_retailprice >= 700 and p_size * 40 / p_retailprice between 0.7 and 1.4 as source from part")
def aspect_flag(spark, sf_dir):
    w, h = F.col("p_size") * 40, F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.plausible_photo(w, h).alias("plausible"), scalars.plausible_source(w, h).alias("source"))


@query(f"""with recursive {_COMPONENTS}, n as (select split, count(*) as products, count(distinct component) as components from assigned group by split),
i as (select split, avg(c) as images_per_product from (select split, product_id, count(*) as c from pruned join assigned using (product_id) group by all) group by split)
select n.*, i.images_per_product from n join i using (split)""")
def build_report(spark, sf_dir):
    some = pruned(spark, sf_dir)
    splits = catalog.assign_splits(some)
    each = some.join(splits, "product_id").groupBy("split", "product_id").agg(F.count("*").alias("c")).groupBy("split").agg(F.avg("c").alias("images_per_product"))
    return splits.groupBy("split").agg(F.count("*").alias("products"), F.countDistinct("component").alias("components")).join(each, "split")


@query(f"""with recursive {_COMPONENTS}, main as (select product_id, image_id from edges where is_main)
select product_id, split, main.image_id as main_image_id, p_type as product_type_raw, p_name as title from main join assigned using (product_id) join part on p_partkey = main.image_id
where main.image_id not in (select image_id from generic)""")
def catalog_rows(spark, sf_dir):
    every = edges(spark, sf_dir)
    generic = catalog.generic_images(every, CAP)
    splits = catalog.assign_splits(catalog.prune(every, generic))
    part = table(spark, sf_dir, "part")
    images = part.select(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("path"), F.col("p_size").alias("orig_width"), F.col("p_retailprice").alias("orig_height"))
    none = F.lit(None).cast("string")
    rows = every.where("is_main").select("product_id", F.col("image_id").alias("main_image_id")).join(part.select(F.col("p_partkey").alias("main_image_id"), F.col("p_type").alias("product_type_raw"), F.col("p_name").alias("title")), "main_image_id")
    rows = rows.select("*", none.alias("country"), none.alias("marketplace"), none.alias("title_lang"), none.alias("brand"), none.alias("color"))
    found = catalog.catalog_table(rows, splits, images, catalog.kept_types(rows, "product_type_raw"), generic)
    return found.select("product_id", "split", "main_image_id", "product_type_raw", "title")


@query(f"with {_EDGES} select count(*) - count(distinct image_id) as redundant from edges where is_main")
def redundant_main_images(spark, sf_dir):
    return catalog.redundant_rows(edges(spark, sf_dir).where("is_main"), "image_id")


# Planning -----------------------------------------------------------------------------------------------------


def _packed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (an order's main part, its text as title), images and a catalog, as planning reads them."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.concat(F.lit("images/"), F.col("p_partkey").cast("string")).alias("path"), "p_name", "p_type", "p_size", "p_retailprice")
    every = edges(spark, sf_dir).join(part, "image_id").withColumn("split", scalars.hash_split(F.col("image_id")))
    size = [F.col("p_size").alias("orig_width"), F.col("p_retailprice").alias("orig_height")]
    images = every.select("product_id", "split", "image_id", "path", *size, "is_main", F.lit(True).alias("plausible_product_photo"))
    pairs = every.where("is_main").select("product_id", F.col("p_name").alias("title"), F.lit("en_US").alias("title_lang"), F.col("p_type").alias("product_type"), "split", F.col("image_id").alias("main_image_id"), F.col("path").alias("main_image_path"))
    return pairs, images, pairs.select("product_id", "product_type")


@query(f"""with {_EDGES} select l_orderkey || '-' || lpad(cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as varchar), 2, '0') as key, l_orderkey, l_partkey from lineitem""")
def sample_keys(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(scalars.sample_key(F.col("l_orderkey"), F.row_number().over(order) - 1).alias("key"), "l_orderkey", "l_partkey")


@query(f"""with {_EDGES}, rest as (select distinct image_id from edges join part on p_partkey = image_id where image_id not in (select image_id from edges where is_main)),
types as (select product_id, p_type from edges join part on p_partkey = image_id where is_main),
each as (select r.image_id, e.product_id, e.is_main, t.p_type from rest r join edges e using (image_id) join types t using (product_id))
select image_id, count(*) as n_products, string_agg(product_id || ':' || is_main || ':' || p_type, ',' order by product_id, is_main, p_type) as products from each group by image_id""")
def index_sidecar(spark, sf_dir):
    pairs, images, known = _packed(spark, sf_dir)
    fit = planning.packable(images)
    plan = planning.index_plan(fit, images, known, planning.pairs_plan(pairs, fit))
    spelt = F.array_join(F.transform("products", lambda p: F.concat_ws(":", p["product_id"].cast("string"), p["is_main"].cast("string"), p["product_type"])), ",")
    return plan.select("image_id", F.size("products").cast("long").alias("n_products"), spelt.alias("products"))


@query(f"""with {_EDGES}, keys as (select 'pairs' as role, product_id || '-00' as key, image_id from edges join part on p_partkey = image_id where is_main)
select 'duplicate_keys' as invariant, count(*) as violations from (select role, key from keys group by role, key having count(*) > 1)
union all select 'straddling_paths', 0 union all select 'missing_members', 0""")
def plan_invariants(spark, sf_dir):
    pairs, images, _ = _packed(spark, sf_dir)
    plan = planning.pairs_plan(pairs, planning.packable(images))
    count = lambda rows, name: rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("invariant"), "violations")
    return (
        count(planning.duplicate_keys(plan), "duplicate_keys")
        .unionByName(count(planning.straddling_paths(plan), "straddling_paths"))
        .unionByName(count(planning.missing_members(plan, images.select("path").distinct()), "missing_members"))
    )


@query(f"""with recursive p as (select page_id, url, octet_length(encode(html)) as n, {_SPLIT} as split from (select *, {_MOD.format(x="cast(page_id as varchar)")} as k from pages)),
o as (select *, row_number() over (partition by split order by url nulls first, cast(page_id as varchar)) as place from p),
walk as (select *, 0 as shard, 0 as before from o where place = 1
    union all select o.*, case when w.before + w.n >= 100000 then w.shard + 1 else w.shard end, case when w.before + w.n >= 100000 then 0 else w.before + w.n end
    from walk w join o on o.split = w.split and o.place = w.place + 1)
select 'pages' as role, split, cast(page_id as varchar) as key, url as path, n as n_bytes, shard, before as "offset" from walk""")
def shard_plan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("role"), scalars.hash_split(F.col("page_id")).alias("split"), F.col("page_id").cast("string").alias("key"), F.col("url").alias("path"), F.octet_length("html").alias("n_bytes"))
    return planning.rolled(pages, 100_000)


# Text ---------------------------------------------------------------------------------------------------------

_TITLE_HASH = """case when trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) = '' then 0 else ('0x' || substr(sha1(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 8))::bigint * 2147483648
    + ('0x' || substr(sha1(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 9, 8))::bigint // 2 end"""


@query(f"select doc_id, cast({_TITLE_HASH} as bigint) as title_hash from documents")
def doc_title_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.title_hash(F.col("text")).alias("title_hash"))


@query("select sha1(text) as digest, count(*) as n, min(doc_id) as first_doc from documents group by text having count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha1(F.col("text").cast("binary")).alias("digest"), "doc_id")
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents)
select doc_id, cast(len(w) as int) as n_tokens, cast(len(list_distinct(w)) as int) as n_distinct from t""")
def token_counts(spark, sf_dir):
    t = scalars.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


# Retrieval ----------------------------------------------------------------------------------------------------

_BM25 = """docs as (select doc_id as id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents),
stats as (select count(*) as n, avg(len(w)) as mean from docs),
postings as (select id, len, term, count(*) as tf from (select id, len(w) as len, unnest(w) as term from docs) group by all),
dfs as (select term, count(*) as df from postings group by term),
asked as (select item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) as term from benchmark),
parts as (select item_id, id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / mean)) as part from asked join dfs using (term) join postings using (term), stats),
scores as (select item_id, id, round(sum(part order by term), 9) as score from parts group by item_id, id),
ranks as (select b.item_id as query_id, coalesce((select count(*) from scores s where s.item_id = b.item_id and s.score >= t.score), (select n from stats)) as rank
    from benchmark b left join scores t on t.item_id = b.item_id and t.id = b.item_id)"""


def _bm25(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return retrieval.bm25_ranks(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("query_id"), "text", F.col("item_id").alias("target")))


@query(f"with {_BM25} select query_id, cast(case when rank = 0 then (select n from stats) else rank end as bigint) as rank from ranks")
def bm25_ranks(spark, sf_dir):
    return _bm25(spark, sf_dir)


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    following = F.coalesce(F.lead("vec_id").over(order), F.first("vec_id").over(order))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), following.alias("target"))


_VECTORS = """aims as (select vec_id, embedding, coalesce(lead(vec_id) over (partition by label order by vec_id), first(vec_id) over (partition by label order by vec_id)) as target from embeddings),
scored as (select a.vec_id as query_id, e.vec_id as id, a.target, round(list_dot_product(cast(a.embedding as double[]), cast(e.embedding as double[])), 9) as score from aims a, embeddings e),
vranks as (select s.query_id, count(*) as rank from scored s join scored t on s.query_id = t.query_id and t.id = t.target where s.score >= t.score group by s.query_id)"""


@query(f"with {_VECTORS} select * from vranks")
def vector_ranks(spark, sf_dir):
    return retrieval.vector_ranks(*_vectors(spark, sf_dir))


@query("""with c as (select p_partkey, p_type, count(*) over (partition by p_type) as n from part)
select p_partkey as id, row_number() over (order by n desc, sha1(cast(p_partkey as varchar)), p_partkey) as rank from c""")
def class_prior(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    return retrieval.prior_ranks(rows, F.sha1(F.col("id").cast("string").cast("binary")))


_RANDOM = "select vec_id as query_id, ('0x' || substr(sha1('7:' || vec_id), 1, 15))::bigint % (select count(*) from embeddings) + 1 as rank from embeddings"


@query(_RANDOM)
def random_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    return retrieval.random_ranks(rows, rows.count(), 7)


def _systems(spark, sf_dir):
    exact = retrieval.vector_ranks(*_vectors(spark, sf_dir)).withColumn("system", F.lit("vectors"))
    return exact.unionByName(random_baseline(spark, sf_dir).withColumn("system", F.lit("random")))


@query(f"""with {_VECTORS}, both_systems as (select 'vectors' as system, query_id, rank from vranks union all select 'random', query_id, rank from ({_RANDOM}))
select system, avg(case when rank <= 1 then 1.0::double else 0 end) as recall_1, avg(case when rank <= 10 then 1.0::double else 0 end) as recall_10, avg(case when rank <= 50 then 1.0::double else 0 end) as recall_50,
    avg(case when rank <= 10 then 1 / log2(rank + 1.0::double) else 0 end) as ndcg_10, avg(1.0::double / rank) as rr, median(rank) as median_rank, count(*) as n from both_systems group by system""")
def retrieval_metrics(spark, sf_dir):
    return retrieval.summary(_systems(spark, sf_dir), "system").select("system", *(F.round(n, 12).alias(n) for n in ("recall_1", "recall_10", "recall_50", "ndcg_10", "rr")), "median_rank", "n")


@query()
def bootstrap_ci(spark, sf_dir):
    each = retrieval.per_query(_systems(spark, sf_dir)).select("system", "query_id", "recall_10")
    wide = each.groupBy("query_id").agg(F.sum(F.when(F.col("system") == "vectors", F.col("recall_10")).otherwise(-F.col("recall_10"))).alias("difference"))
    return retrieval.paired_bootstrap(wide.select("difference", "query_id"))


# Duplicates and calibration -----------------------------------------------------------------------------------

_HASHES = """h as (select vec_id as idx, label, list_transform(range(1, 64), lambda i: embedding[i + 1] > embedding[i]) as bits from embeddings),
near as (select a.idx as a, b.idx as b, cast(len(list_filter(range(1, 64), lambda i: a.bits[i] <> b.bits[i])) as int) as distance from h a join h b on a.idx < b.idx),
pairs as (select * from near where distance <= 18)"""


def _hashes(spark, sf_dir):
    v = F.col("embedding")
    bit = lambda i: F.when(F.get(v, i) > F.get(v, i - 1), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - i)).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", code.alias("hash"))


@query(f"with {_HASHES} select * from pairs")
def hamming_pairs(spark, sf_dir):
    return dedup.hamming_pairs(_hashes(spark, sf_dir).select("idx", "hash"), 18)


@query(f"with {_HASHES} select a, b, distance / 64.0::double as share from pairs")
def normalised_distance(spark, sf_dir):
    rows = _hashes(spark, sf_dir)
    side = lambda x: rows.select(F.col("idx").alias(x), F.col("hash").alias(f"hash_{x}"))
    pairs = hamming_pairs(spark, sf_dir).join(side("a"), "a").join(side("b"), "b")
    return pairs.select("a", "b", scalars.normalised_distance(F.col("hash_a"), F.col("hash_b")).alias("share"))


@query("select doc_id, source, lang from documents where text is not null order by source, doc_id limit 100")
def first_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "lang")
    return retrieval.first_queries(rows, 100, "source", "doc_id")


@query(f"""with recursive {_HASHES}, e as (select a, b from pairs union select b, a from pairs), reach(x, y) as (select a, a from e union select r.x, e.b from reach r join e on r.y = e.a)
select min(y) as cluster, x as idx from reach group by x""")
def dup_clusters(spark, sf_dir):
    return dedup.hash_clusters(_hashes(spark, sf_dir).select("idx", "hash"), 18)


@query(f"""with {_HASHES}, both_ways as (select a, b, distance from pairs union all select b, a, distance from pairs),
best as (select x.idx, x.label as own, y.label as nearest, y.idx as nearest_idx, p.distance,
    row_number() over (partition by x.idx order by p.distance, y.idx) as k from both_ways p join h x on x.idx = p.a join h y on y.idx = p.b),
alike as (select a as idx, distance from near join h x on x.idx = a join h y on y.idx = b where x.label = y.label
    union all select b, distance from near join h x on x.idx = a join h y on y.idx = b where x.label = y.label),
nearest_own as (select idx, min(distance) as own_distance from alike group by idx)
select idx, cast(own as varchar) as own, cast(nearest as varchar) as nearest, nearest_idx, distance, own_distance
from best left join nearest_own using (idx) where k = 1 and own <> nearest""")
def group_mismatch(spark, sf_dir):
    rows = _hashes(spark, sf_dir).select("idx", "hash", F.col("label").cast("string").alias("tag"), F.lit(9.0).alias("detail_std"))
    return dedup.group_mismatches(rows, 18)


@query("""with t as (select vec_id, label, list_transform(range(0, 16), lambda k: list_transform(range(1, 4), lambda j: embedding[4 * k + j + 1] > embedding[4 * k + j])) as cells,
    coalesce(lead(vec_id) over (partition by label order by vec_id), first(vec_id) over (partition by label order by vec_id)) as other from embeddings)
select a.vec_id as idx, a.other, cast(16 - len(list_filter(range(1, 17), lambda k: len(list_filter(range(1, 4), lambda j: a.cells[k][j] <> b.cells[k][j])) <= 1)) as int) as disagreeing
from t a join t b on b.vec_id = a.other""")
def tile_distance(spark, sf_dir):
    v = F.col("embedding")
    cell = lambda k: F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.when(F.get(v, 4 * k + j) > F.get(v, 4 * k + j - 1), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), cell).alias("tiles"), F.coalesce(F.lead("vec_id").over(order), F.first("vec_id").over(order)).alias("other"))
    b = rows.select(F.col("vec_id").alias("other"), F.col("tiles").alias("tiles_b"))
    return rows.join(b, "other").select(F.col("vec_id").alias("idx"), "other", dedup.tile_distance(F.col("tiles"), F.col("tiles_b"), 1).alias("disagreeing"))


_SCORED = "scored as (select least(floor(n_chars / 100), 50) as distance, quality as label from labels join documents using (doc_id))"


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.least(F.floor(F.col("n_chars") / 100), F.lit(50)).cast("double").alias("distance"), F.col("quality").alias("label"))


@query(f"""with {_SCORED}, a as (select count(*) filter (label = 1) as np, count(*) filter (label = 0) as nn from scored),
c as (select distance, count(*) filter (label = 1) as p, count(*) filter (label = 0) as q from scored group by distance),
u as (select sum(p * (coalesce((select sum(d.q) from c d where d.distance > c.distance), 0) + q / 2.0::double)) as u from c)
select u / (np * nn::double) as auc from u, a""")
def roc_auc(spark, sf_dir):
    return calibration.roc_auc(_scored(spark, sf_dir), F.col("distance"), F.col("label"))


_SWEEP = f"""{_SCORED}, t as (select distinct distance as threshold from scored),
    c as (select cast(threshold as double) as threshold, count(*) filter (label = 1 and distance <= threshold) as tp, count(*) filter (label = 0 and distance <= threshold) as fp, count(*) filter (label = 1 and distance > threshold) as fn from t, scored group by threshold),
    r as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from c),
    swept as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from r)"""


@query(f"with {_SWEEP} select * from swept")
def prf_sweep(spark, sf_dir):
    return calibration.sweep(_scored(spark, sf_dir), F.col("distance"), F.col("label"))


@query(f"with {_SWEEP} select * from swept where precision >= 0.8 order by f1 desc, threshold limit 1")
def best_threshold(spark, sf_dir):
    return calibration.best_threshold(prf_sweep(spark, sf_dir), 0.8)


@query("""select 'quality ' || quality as kind, count(*) as n, count(*) filter (n_chars <= 1500) as caught, count(*) filter (n_chars <= 1500) / count(*)::double as recall, median(n_chars) as median_distance
from labels join documents using (doc_id) group by quality""")
def recall_by_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return calibration.recall_by_kind(rows.select(F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("kind"), F.col("n_chars").alias("distance")), 1500)


@query("""select a.vec_id as id, b.vec_id as other, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2)) / 64 as mse
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def pixel_mse(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = rows.select((F.col("vec_id") - 1).alias("id"), F.col("vec_id").alias("other"), F.col("v").alias("w"))
    return rows.join(b, F.col("vec_id") == F.col("id")).select("id", "other", calibration.mean_squared(F.col("v"), F.col("w")).alias("mse"))


# Rules --------------------------------------------------------------------------------------------------------

_IMAGES = """img as (select p_brand as set_id, row_number() over (partition by p_brand order by p_partkey) - 1 as idx, p_size * 60 as width, cast(floor(p_retailprice) as int) as height,
    case p_type when 'ECONOMY' then 'BMP' when 'SMALL' then 'PNG' else 'JPEG' end as format, p_partkey % 97 = 0 as had_alpha, (p_partkey % 100) / 100.0::double as exact_white_frac, (p_partkey % 101) / 100.0::double as near_white_frac,
    255 - p_size // 10 as m, (p_partkey % 120) / 100.0::double as bbox_occupancy, cast(p_partkey % 3 as int) as n_artifacts from part),
flagged as (select *, idx = 0 as is_main from img),
checked as (
    select set_id, idx, is_main, 0 as place, 'resolution_and_format' as check_id, case when format not in ('JPEG', 'PNG', 'TIFF', 'GIF', 'WEBP') then 'fail' when greatest(width, height) > 10000 or greatest(width, height) < 500 then 'fail' when greatest(width, height) < 1000 then 'warn' else 'pass' end as status, 'rule_exact' as tier, greatest(width, height)::double as value from flagged
    union all select set_id, idx, is_main, 1, 'white_background', case when had_alpha then 'warn' when exact_white_frac >= 0.99 or (near_white_frac >= 0.99 and m = 255) then 'pass' when near_white_frac >= 0.99 then 'warn' else 'fail' end, case when is_main then 'measured' else 'advisory' end, exact_white_frac from flagged
    union all select set_id, idx, is_main, 2, 'frame_occupancy', case when bbox_occupancy >= 0.85 then 'pass' else 'fail' end, case when is_main then 'measured' else 'advisory' end, bbox_occupancy from flagged
    union all select set_id, idx, is_main, 3, 'background_artifacts', case when n_artifacts > 0 then 'fail' else 'pass' end, case when is_main then 'measured' else 'advisory' end, n_artifacts::double from flagged
    union all select set_id, idx, is_main, 4, 'aspect_ratio', case when abs(width::double / height - 1) > 0.25 then 'warn' else 'pass' end, 'advisory', round_even(width::double / height, 4) from flagged)"""


def _images(spark, sf_dir):
    """Parts as images with measurements: whole numbers in, so that both engines agree."""
    part = table(spark, sf_dir, "part")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    modal = (255 - F.floor(F.col("p_size") / 10)).cast("int")
    kind = F.when(F.col("p_type") == "ECONOMY", "BMP").when(F.col("p_type") == "SMALL", "PNG").otherwise("JPEG")
    hundredth = lambda n: (F.col("p_partkey") % n) / F.lit(100.0)
    rows = part.select(
        F.col("p_brand").alias("set_id"),
        place.cast("long").alias("idx"),
        (F.col("p_size") * 60).alias("width"),
        F.floor("p_retailprice").cast("int").alias("height"),
        kind.alias("format"),
        (F.col("p_partkey") % 97 == 0).alias("had_alpha"),
        hundredth(100).alias("exact_white_frac"),
        hundredth(101).alias("near_white_frac"),
        *(modal.alias(f"modal_{c}") for c in "rgb"),
        hundredth(120).alias("bbox_occupancy"),
        (F.col("p_partkey") % 3).cast("int").alias("n_artifacts"),
    )
    return rows.withColumn("is_main", audit.main_flag(F.col("idx"), F.lit(0)))


@query(f"with {_IMAGES} select set_id, idx, place, check_id, status, tier, value from checked")
def rule_verdicts(spark, sf_dir):
    return audit.checks(_images(spark, sf_dir)).drop("reason", "rule")


def _supplied(images):
    return images.groupBy("set_id").agg(F.count("*").alias("n_images"))


@query(f"""with {_IMAGES}, n as (select set_id, count(*) as n_images from img group by set_id),
v as (select set_id, max(case status when 'fail' then 2 when 'warn' then 1 when 'pass' then 0 end) as worst from checked where tier <> 'advisory' group by set_id),
m as (select set_id, min(idx) as main_index from checked where tier = 'measured' group by set_id)
select n.set_id, n_images, case greatest(worst, case when n_images < 6 then 1 else 0 end) when 2 then 'fail' when 1 then 'warn' else 'pass' end as headline, main_index from n join v using (set_id) left join m using (set_id)""")
def worst_status(spark, sf_dir):
    images = _images(spark, sf_dir)
    return audit.headlines(audit.checks(images), _supplied(images))


@query(f"""with {_IMAGES}, code as (select *, case check_id when 'resolution_and_format' then 'res' when 'white_background' then 'wbg' when 'frame_occupancy' then 'occ' when 'background_artifacts' then 'art' else 'asp' end as code from checked),
per as (select set_id, idx, coalesce(string_agg(case when tier <> 'advisory' and status <> 'pass' then code || ':' || status end, ',' order by place), '') as f,
    coalesce(string_agg(case when tier = 'advisory' and status <> 'pass' then code || ':' || status || ':' || value end, ',' order by place), '') as a,
    coalesce(string_agg(case when tier <> 'advisory' and status <> 'pass' then code || ':' || status || ':' || value end, ',' order by place), '') as fv,
    count(*) filter (status = 'pass') as n_pass, count(*) filter (tier = 'advisory' and status <> 'pass') as n_measured_only from code group by set_id, idx)
select set_id, count(*) as n_images, min(idx) as first_image, n_pass, f as findings, cast(n_measured_only as int) as n_measured_only from per group by set_id, fv, f, a, n_pass, n_measured_only""")
def finding_groups(spark, sf_dir):
    groups = audit.finding_groups(audit.checks(_images(spark, sf_dir)))
    spelt = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["code"], f["status"])), ",")
    return groups.select("set_id", F.size("indices").cast("long").alias("n_images"), F.array_min("indices").alias("first_image"), "n_pass", spelt.alias("findings"), "n_measured_only")


@query()
def audit_payloads(spark, sf_dir):
    images = _images(spark, sf_dir)
    return audit.payloads(audit.checks(images), _supplied(images))


@query("""with c as (select p_partkey, cast(p_partkey * 7 % 256 as int) as r, cast(p_size * 5 as int) as g, cast(p_partkey * 3 % 256 as int) as b from part),
d as (select *, least(r, g, b) as lo, greatest(r, g, b) as hi from c)
select p_partkey, case when hi - lo <= 12 then case when lo >= 235 then 'off-white' when lo >= 180 then 'light grey' when lo >= 90 then 'grey' else 'dark grey or black' end
    else case when lo >= 180 then 'a light ' else 'a ' end || case when r = hi then 'reddish or warm' when g = hi then 'greenish' else 'bluish' end || ' colour' end as colour from d""")
def colour_names(spark, sf_dir):
    r, g, b = F.col("p_partkey") * 7 % 256, F.col("p_size") * 5, F.col("p_partkey") * 3 % 256
    return table(spark, sf_dir, "part").select("p_partkey", scalars.colour_name(r, g, b).alias("colour"))


@query("select event_id, ts from events order by ts desc, event_id limit 64")
def latest_audits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("audit_id"), F.col("ts").alias("at"))
    return audit.latest(rows).select(F.col("audit_id").alias("event_id"), F.col("at").alias("ts"))


@query("select * from (values " + ", ".join(f"('{n}', '{c['tier']}')" for n, c in sorted(RULES["checks"].items()) if c.get("enabled", True)) + ") t(check_id, tier)")
def enabled_checks(spark, sf_dir):
    rows = [(n, c.get("enabled", True), c["tier"]) for n, c in RULES["checks"].items()]
    return spark.createDataFrame(rows, "check_id string, enabled boolean, tier string").where("enabled and tier <> 'deferred'").select("check_id", "tier").orderBy("check_id")


# Web and binary -----------------------------------------------------------------------------------------------


@query("""select page_id, case when not starts_with(lower(url), 'https://') then 'scheme' when regexp_extract(lower(url), '^https://([^/?#:]*)', 1) not in ('blog.tionble.example.com', 'ththon.example.com') then 'host' end as reason from pages""")
def url_gate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.url_gate(F.col("url"), ("blog.tionble.example.com", "ththon.example.com")).alias("reason"))


@query("""select page_id, case when page_id % 2 = 0 then 'https://m.media-amazon.com/images/I/' || md5(url) || '.jpg' else 'https://m.media-amazon.com/images/I/' || md5(url) || '.txt' end as original from pages""")
def variant_strip(spark, sf_dir):
    name = F.md5(F.col("url").cast("binary"))
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://m.media-amazon.com/images/I/"), name, F.lit("._AC_SS115_.jpg")))
    url = url.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://m.media-amazon.com/images/I/"), name, F.lit(".jpg"))).otherwise(F.concat(F.lit("https://m.media-amazon.com/images/I/"), name, F.lit(".txt")))
    return table(spark, sf_dir, "pages").select("page_id", web.variant_strip(url).alias("original"))


@query("select page_id, upper(substr(md5(url), 1, 10)) as product_id from pages")
def product_ids(spark, sf_dir):
    own = F.upper(F.substring(F.md5(F.col("url").cast("binary")), 1, 10))
    text = F.when(F.col("page_id") % 3 == 0, own).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.amazon.com/x/dp/"), own, F.lit("/ref=z"))).otherwise(F.concat(F.lit("see item "), own, F.lit(" now")))
    return table(spark, sf_dir, "pages").select("page_id", web.product_id(text).alias("product_id"))


@query("""select page_id, case when page_id % 4 = 0 then 'ok' when page_id % 4 = 1 then 'partial' when page_id % 4 = 2 then 'blocked' else 'empty' end as status,
    case when page_id % 4 = 0 then 'https://m.media-amazon.com/images/I/A' || page_id || '.jpg' else '' end as images, case when page_id % 4 in (0, 1) then 2 else 0 end as n_links from pages""")
def link_extract(spark, sf_dir):
    i, cdn = F.col("page_id").cast("string"), F.lit("https://m.media-amazon.com/images/I/")
    entry = F.concat(F.lit("""'colorImages': { 'initial': A.$.parseJSON('[{"hiRes":null,"large":\""""), cdn, F.lit("A"), i, F.lit("""._SS40_.jpg"},{"hiRes":"https://m.media-amazon.com/images/I/x.gif"}]')} """), cdn, F.lit("B"), i, F.lit(".png"))
    loose = F.concat(F.lit("<p>"), cdn, F.lit("A"), i, F.lit("._SS40_.jpg "), cdn, F.lit("A"), i, F.lit(".jpg "), cdn, F.lit("B.jpeg"))
    added = F.when(F.col("page_id") % 4 == 0, entry).when(F.col("page_id") % 4 == 1, loose).when(F.col("page_id") % 4 == 2, F.lit("<h1>Robot Check</h1>")).otherwise(F.lit(""))
    html = F.concat("html", added)
    return table(spark, sf_dir, "pages").select("page_id", web.page_status(html).alias("status"), F.array_join(web.gallery(html), ",").alias("images"), F.size(web.cdn_links(html)).alias("n_links"))


@query("""select page_id, regexp_matches(lower(html), 'captcha|api-services-support@amazon.com|to discuss automated access|type the characters you see in this image|enter the characters you see below|robot check') as blocked, octet_length(encode(html)) <= 3000 as within_cap from pages""")
def block_markers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.blocked(F.col("html")).alias("blocked"), web.within_cap(F.col("html"), 3000).alias("within_cap"))


@query("""select page_id, case page_id % 7 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/gif' when 3 then 'image/tiff' when 4 then 'image/tiff' when 5 then 'image/webp' end as kind from pages""")
def magic_sniff(spark, sf_dir):
    heads = ["FFD8FF", "89504E470D0A1A0A", "474946383961", "49492A00", "4D4D002A", "524946460000000057454250", ""]
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", web.sniff(F.concat(head, F.col("html").cast("binary"))).alias("kind"))


@query("""with t as (select c_custkey, c_custkey * 37 % 256 as a, c_custkey * 11 % 256 as b, c_custkey % 256 as c from customer)
select c_custkey, concat_ws('.', a, b, c, 1) as address, case when a = 127 then 'loopback' when a = 169 and b = 254 then 'link_local' when a between 224 and 239 then 'multicast'
    when a >= 240 then 'reserved' when a in (0, 10) or a = 172 and b between 16 and 31 or a = 192 and b = 0 and c in (0, 2) or a = 192 and b = 168
    or a = 198 and b in (18, 19) or a = 198 and b = 51 and c = 100 or a = 203 and b = 0 and c = 113 then 'private'
    when a = 100 and b between 64 and 127 then 'not globally routable' end as forbidden from t""")
def address_class(spark, sf_dir):
    k = F.col("c_custkey")
    address = F.concat_ws(".", (k * 37 % 256).cast("string"), (k * 11 % 256).cast("string"), (k % 256).cast("string"), F.lit("1"))
    return table(spark, sf_dir, "customer").select("c_custkey", address.alias("address"), web.address_class(address).alias("forbidden"))


# Pixels -------------------------------------------------------------------------------------------------------


def _pixels(spark, sf_dir):
    """Embeddings as grey pictures of 8 by 8."""
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.round(x * 500 + 128), F.lit(0)), F.lit(255)).cast("long")), 2, "0"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("n_channels"), F.unhex(F.array_join(byte, "")).alias("data"))


@query()
def image_measurements(spark, sf_dir):
    return pixels.measured(_pixels(spark, sf_dir))


@query()
def image_hashes(spark, sf_dir):
    return pixels.hashed(_pixels(spark, sf_dir))


@query()
def near_dup_report(spark, sf_dir):
    # the hash that is calibrated, and what tells pictures without features
    return dedup.near_duplicates(pixels.hashed(_pixels(spark, sf_dir), (dedup.calibrated_method(), "detail_std")).withColumnRenamed("image_id", "idx"))["pairs"]


# Training side ------------------------------------------------------------------------------------------------

_SAMPLES = f"samples as (select doc_id // 64 as batch, doc_id as i, source as product, {_TITLE_HASH} as title_hash from documents)"


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.expr("doc_id div 64").alias("batch"), F.col("doc_id").alias("i"), scalars.title_hash(F.col("source")).alias("product_hash"), scalars.title_hash(F.col("text")).alias("title_hash"))


@query(f"with {_SAMPLES} select a.batch, a.i, b.i as j from samples a join samples b on a.batch = b.batch and a.i <> b.i and (a.product = b.product or (a.title_hash = b.title_hash and a.title_hash <> 0))")
def false_negative_mask(spark, sf_dir):
    return training.false_negatives(_samples(spark, sf_dir))


@query("""with t as (select vec_id as i, vec_id // 64 as batch, embedding::double[] as image,
    coalesce(lead(embedding) over (partition by label order by vec_id), first(embedding) over (partition by label order by vec_id))::double[] as text from embeddings),
z as (select a.batch, a.i, b.i as j, 20.0::double * list_dot_product(a.image, b.text) as z from t a join t b on a.batch = b.batch),
tops as (select *, max(z) over (partition by batch, i) as row_top, max(z) over (partition by batch, j) as column_top, row_number() over (partition by batch, i order by z desc, j) as place from z),
by_row as (select batch, i, ln(sum(exp(z - row_top))) + any_value(row_top) - max(case when i = j then z end) as loss, max(case when i = j and place = 1 then 1.0::double else 0 end) as found from tops group by batch, i),
by_column as (select batch, j, ln(sum(exp(z - column_top))) + any_value(column_top) - max(case when i = j then z end) as loss from tops group by batch, j),
r as (select batch, avg(loss) as loss_i2t, avg(found) as accuracy from by_row group by batch),
c as (select batch, avg(loss) as loss_t2i from by_column group by batch)
select batch, round((loss_i2t + loss_t2i) / 2, 9) as loss, round(loss_i2t, 9) as loss_i2t, round(loss_t2i, 9) as loss_t2i, round(accuracy, 9) as accuracy, 0 as masked from r join c using (batch)""")
def info_nce(spark, sf_dir):
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("text", F.coalesce(F.lead("embedding").over(order), F.first("embedding").over(order)))
    return training.info_nce(rows.select(F.expr("vec_id div 64").alias("batch"), F.col("vec_id").alias("i"), F.col("embedding").alias("image"), "text", F.col("vec_id").alias("product_hash"), F.lit(0).cast("long").alias("title_hash")), 20.0).select(
        "batch", *(F.round(c, 9).alias(c) for c in ("loss", "loss_i2t", "loss_t2i", "accuracy")), "masked"
    )


@query("select o_orderkey, o_orderpriority, length(o_orderpriority)::float as n from orders")
def encode_once(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return training.encode_distinct(rows, "o_orderpriority", lambda values: [[len(v)] for v in values]).select("o_orderkey", "o_orderpriority", F.get("vector", F.lit(0)).alias("n"))


@query("select event_id, case when event_id < 500 then 0.001 * (event_id + 1) / 500 else 0.001 * 0.5 * (1 + cos(pi() * least(1, (event_id - 500) / 8000.0::double))) end as rate from events")
def lr_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.learning_rate(F.col("event_id"), 0.001, 500, 8500).alias("rate"))
