"""URL rules with redirect equivalence, in DataFrame operations only.

A rule is (action, host, path). It fits its host and all subdomains where the url's path starts with the rule's;
of several that fit, the longest decides. Urls that redirect to each other, or name one another as canonical, are
aliases: the components of that graph share decisions. A url that no rule fits is allowed if a rule allows any
alias, else blocked if a rule blocks any alias, else allowed. A relative link is resolved against its page's url.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, has no alias and is
allowed; such rows pass by all joins. Repeated rows are judged alike. An empty table gives no rows. Very long urls and
pages are read whole. Extra columns are ignored, whatever their names. Equal rules of both actions: allow wins. A link
of another scheme than http, or to a fragment, is no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import star_components
from ..plans.cut import cut

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Query parameters that only track where a click came from: fixed values.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, CAPITALS, SMALL)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node: no scheme, fragment, tracking parameters or capitals in the host; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(=|$)")), "&")
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def relative(url: Column, link: Column) -> Column:
    """The path, and what follows it, that ``link`` without a host means on the page at ``url``."""
    path = path_of(url)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1)
    return F.when(link.startswith("/"), link).when(link.startswith("?"), F.concat(F.when(path == "", "/").otherwise(path), link)).otherwise(F.concat(folder, link))


def without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` parts taken out; a query or fragment stays as it is."""
    parts = F.split(F.regexp_extract(path, r"(?s)^([^?#]*)", 1), "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    last = F.element_at(parts, -1)
    closed = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), closed, F.regexp_extract(path, r"(?s)^[^?#]*(.*)$", 1))


def links(pages: DataFrame) -> DataFrame:
    """``(url, target)`` of each canonical link and refresh redirect in the html of ``pages`` (url, html)."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    found = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)),
    )
    each = pages.where("url is not null and html is not null").select("url", F.explode(found).alias("link"))
    scheme, site = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    link = F.regexp_replace("link", "&amp;", "&")
    target = (
        F.when(F.col("link").rlike("(?i)^https?://"), link)
        .when(F.col("link").startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(F.col("link").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | F.col("link").startswith("#"), F.lit(None))
        .otherwise(F.concat(site, without_dots(relative(F.col("url"), link))))
    )
    return each.select("url", target.alias("target")).where("target is not null and url like '%://%'")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, action)`` of the longest rule for each distinct host and path that a rule fits.

    An equi-join on each suffix of the host, so the number of rules does not multiply the urls; Spark broadcasts
    the rules if they are small.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    each = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    known = rules.select(lower_ascii(F.col("host")).alias("suffix"), F.col("path").alias("prefix"), "action")
    fits = each.join(known, "suffix").where(F.col("path").startswith(F.col("prefix")))
    rule = F.concat("suffix", "prefix")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("ok"), rule.alias("rule"), F.col("action").alias("action")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Judges each row of ``pages`` (page_id, url, html) by ``rules`` (action, host, path).

    ``redirects`` (url, target) adds observed redirects to the links found in the html. Returns page_id, host,
    path, rule, verdict and alias_of (the component's least node, null for a url without aliases).
    """
    every = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    # what has no host fits no rule and has no alias: no key of many rows in the joins
    rows, plain = every.where("host <> ''"), every.where("host = ''")
    found = links(pages)
    if redirects is not None:
        found = found.unionAll(redirects.select("url", "target"))
    ends = cut(
        found.select(
            *(x for n in ("url", "target") for x in (host_of(F.col(n)).alias(f"{n}_host"), path_of(F.col(n)).alias(f"{n}_path"), node_of(F.col(n)).alias(f"{n}_node")))
        ).distinct()
    )
    aliases = star_components(ends, "url_node", "target_node")
    nodes = rows.select("node", "host", "path")
    for n in ("url", "target"):
        nodes = nodes.unionAll(ends.select(f"{n}_node", f"{n}_host", f"{n}_path"))
    matched = match_rules(nodes, rules)
    decided = (
        nodes.distinct()
        .join(aliases, "node")
        .join(matched, ["host", "path"])
        .groupBy("component")
        .agg(F.max((F.col("action") == "allow").cast("int")).alias("allowed"))
    )
    shared = aliases.join(decided, "component", "left")
    none = plain.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
    judged = (
        rows.join(matched, ["host", "path"], "left")
        .join(shared, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("action", F.when(F.col("allowed") == 0, "block"), F.lit("allow")).alias("verdict"),
            F.col("component").alias("alias_of"),
        )
    )
    return judged.unionAll(none)
