"""The queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, html_text, jaccard_join, multi_index, packing, quality, quotes, sharding, toxicity, url_filter

#: (action, host, path): fixed values.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 10)


def op4_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), 40)


def op6_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op9_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op10_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_word_vectors,
        op2_templates,
        op3_multi_index,
        op4_line_blocks,
        op5_hilbert_shards,
        op6_counterfactual,
        op7_best_fit,
        op8_signature_trees,
        op9_redirect_rules,
        op10_quotation,
    )
    return {f.__name__: f for f in every}


#: Host, path and node of {u}, as DuckDB expressions.
_HOST = "coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
_NODE = """case when {h} <> '' then {h} || {p} || coalesce('?' || nullif(array_to_string(list_filter(
    string_split(regexp_extract({u}, '(?s)^[^?#]*\\?([^#]*)', 1), '&'),
    lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)')), '&'), ''), '') end"""


def _parts(u: str, prefix: str = "") -> str:
    h, p = _HOST.format(u=u), _PATH.format(u=u)
    return f"{h} as {prefix}host, {p} as {prefix}path, {_NODE.format(u=u, h=h, p=p)} as {prefix}node"


OP9_SQL = f"""
with recursive rules(action, rhost, rpath) as (values {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}),
r as (select page_id, url, html, {_parts("url")} from pages),
tags as (select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) as tag from pages where url like '%://%'),
raw as (
    select url, regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) as link from tags
    where regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b')
    union all
    select url, regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) from tags
    where regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
based as (
    select url, replace(link, '&amp;', '&') as link, regexp_extract(url, '(?s)^(.*?)://', 1) as scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as site,
        coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') as path
    from raw),
meant as (
    select url, link, scheme, site, case when link[1] = '/' then link when link[1] = '?' then path || link
        else regexp_extract(path, '(?s)^(.*/)', 1) || link end as full_path
    from based),
parts as (select *, string_split(regexp_extract(full_path, '(?s)^([^?#]*)', 1), '/') as p, regexp_extract(full_path, '(?s)^[^?#]*(.*)$', 1) as rest from meant),
walked as (
    select url, link, scheme, site, p, rest, list_reduce(list_prepend([]::varchar[], list_transform(p[2:], lambda x: [x])),
        lambda a, x: case when x[1] = '.' then a when x[1] = '..' then a[1:len(a) - 1] else list_concat(a, x) end) as kept
    from parts),
links as (
    select url, case when regexp_matches(link, '^(?i)https?://') then link when link like '//%' then scheme || ':' || link
        when regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') or link[1] = '#' then null
        else site || '/' || array_to_string(kept, '/') || case when p[-1] in ('.', '..') and len(kept) > 0 then '/' else '' end || rest end as target
    from walked),
ends as (select distinct {_parts("url", "a")}, {_parts("target", "b")} from links where target is not null),
edges as (select anode as x, bnode as y from ends union select bnode, anode from ends),
reach(node, other) as (select x, x from edges where x is not null union select r.node, e.y from reach r join edges e on r.other = e.x where e.y is not null),
aliases as (select node, min(other) as component from reach group by node having min(other) <> max(other)),
nodes as (select node, host, path from r union select anode, ahost, apath from ends union select bnode, bhost, bpath from ends),
matched as (
    select host, path, rhost || rpath as rule, action from (select distinct host, path from nodes)
    join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
    qualify row_number() over (partition by host, path order by length(rhost || rpath) desc, action) = 1),
decided as (
    select component, max((action = 'allow')::int) as allowed
    from nodes join aliases using (node) join matched using (host, path) group by component)
select r.page_id, r.host, r.path, m.rule, coalesce(m.action, case when d.allowed = 0 then 'block' end, 'allow') as verdict, a.component as alias_of
from r left join matched m using (host, path) left join aliases a on a.node = r.node left join decided d using (component)
"""


OP8_SQL = """
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as w
    from documents),
sets as (
    select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words),
each as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
pairs as (
    select a.doc_id as a, b.doc_id as b from each a join each b on a.shingle = b.shingle and a.doc_id < b.doc_id
        and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union select b, a from pairs),
reach(node, other) as (select a, a from edges union select r.node, e.b from reach r join edges e on r.other = e.a),
least as (select node, min(other) as component from reach group by node)
select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(component, doc_id) as component_id from sets left join least on node = doc_id
"""


OP3_SQL = """
with w as (select max(len(embedding)) as dims from embeddings),
v as (select distinct vec_id, list_transform(range(1, dims + 1), lambda i: coalesce(embedding[i] > 0 and not isnan(embedding[i]), false)) as code from embeddings, w where embedding is not null),
p as (
    select q.vec_id as query_id, v.vec_id, min(len(list_filter(list_zip(q.code, v.code), lambda x: x[1] <> x[2]))) as d
    from v q join v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id group by all),
r as (select query_id, vec_id, d, row_number() over (partition by query_id order by d, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, cast(d as int) as distance from r where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_multi_index": OP3_SQL, "op8_signature_trees": OP8_SQL, "op9_redirect_rules": OP9_SQL}
