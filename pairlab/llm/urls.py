"""URL filters with redirect equivalence (operator 3).

A rule has a host and a path; it fits its host and all subdomains where the
url's path starts with the rule's.  The longest fitting rule wins.  Urls without
a fitting rule take part in equivalence: redirects (a table, or a page's
``http-equiv=refresh``), canonical links (``rel=canonical``, ``og:url``) and the
url without its fragment are edges, their connected components hold the aliases
of one resource, and a block decision of any alias spreads to the undecided
ones, unless some alias is explicitly allowed.  A rule's own verdict is never
changed.  Urls that fit nothing and lie with nothing are allowed.

Rules meet urls through an equi-join on host suffixes (a host has few), on
distinct hosts and paths, so a popular host costs one row a path.  Components
are computed by distributed label contraction over 64-bit numbers of the urls,
which are dealt out exactly (no hashes that could collide); the urls themselves
are shuffled before and after the rounds only.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and has no aliases; all links of a page count, with the basic
character entities decoded and resolved against the page (queries, dot segments);
links of schemes without ``//`` (mailto, javascript, data) name no page; repeated rows get equal results; an empty table gives an empty result.  Extra
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import connected_components

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a page names another address of itself: canonical link, og:url, meta refresh.
LINKS = (r"""(?is)<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b[^">]*"|'[^'>]*\bcanonical\b[^'>]*'|canonical\b)[^>]*>""",
         r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']?og:url\b[^>]*>""",
         r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""")
TARGETS = (r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""",
           r"""(?is)\bcontent\s*=\s*["']?([^"'\s>]+)""",
           r"""(?is)\bcontent\s*=\s*["']?[^>]*?\burl\s*=\s*["']?([^"'\s>]+)""")
#: Character entities that occur in addresses; the ampersand's own come last.
ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#x2F;", "/"), ("&#x2f;", "/"),
            ("&#47;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _without_dots(url: Column) -> Column:
    """A url whose path has no ``.`` and ``..`` segments."""
    head, rest = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    parts = F.split(F.substring(path(url), 2, 1 << 30), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))
    last = F.element_at(parts, -1)
    ended = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    clean = F.concat(head, F.lit("/"), F.array_join(ended, "/"), rest)
    return F.when(path(url).rlike(r"/\.\.?(/|$)"), clean).otherwise(url)


def _resolved(link: Column, url: Column) -> Column:
    """A link of the page ``url`` as a full url; null for a scheme that names no host."""
    for entity, letter in ENTITIES:
        link = F.replace(link, F.lit(entity), F.lit(letter))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(url, URL, 1))
    page = path(url)
    folder = F.regexp_replace(page, r"[^/]*$", "")
    whole = (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
             .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
             .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
             .when(link.startswith("/"), F.concat(root, link))
             .when(link.startswith("?"), F.concat(root, page, link))
             .when(link.startswith("#"), F.concat(F.regexp_replace(url, r"(?s)#.*$", ""), link))
             .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link)))
    return _without_dots(whole)


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``a, b``: urls that name the same resource, from ``pages (url, html)`` and ``redirects (a, b)``."""
    proper = pages.filter(F.col("url").contains("://"))
    def targets(tag: str, target: str) -> Column:
        tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(tag), F.lit(0))
        return F.transform(tags, lambda t: F.regexp_extract(t, target, 1))
    found = list(map(targets, LINKS, TARGETS))
    links = proper.select("url", F.explode(F.array_distinct(F.concat(*found))).alias("link")).filter("link <> ''")
    edges = links.select(F.col("url").alias("a"), _resolved(F.col("link"), F.col("url")).alias("b"))
    edges = edges.unionByName(proper.filter(F.col("url").contains("#")).select(
        F.col("url").alias("a"), F.regexp_replace("url", r"(?s)#.*$", "").alias("b")))
    edges = edges.filter("b IS NOT NULL AND a <> b")
    # a link with a fragment names the resource without it
    edges = edges.withColumn("b", F.regexp_replace("b", r"(?s)#.*$", ""))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL"))
    return edges.distinct()


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, action`` for each distinct host and path of ``urls`` that a rule fits."""
    pairs = urls.select("host", "path").filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    fits = pairs.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(
        named, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    longest = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "action")).alias("best")
    return fits.groupBy("host", "path").agg(longest).select("host", "path", "best.rule", "best.action")


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, url``: a number for each url of ``edges (a, b)``, and the edges between different urls as numbers.

    The numbers are written once, so that a task made again reads the same ones.
    """
    proper = edges.filter("a <> b")
    urls = proper.select(F.explode(F.array("a", "b")).alias("url")).distinct()
    nodes = saved(urls.select(F.monotonically_increasing_id().alias("node"), "url"))
    left, right = (nodes.select(F.col("url").alias(c), F.col("node").alias(f"{c}_node")) for c in "ab")
    links = proper.join(left, "a").join(right, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return nodes, links


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row of ``pages (page_id, url, html)``.

    ``rules`` has ``host, path, action`` (allow or block).
    """
    edges = saved(alias_edges(pages, redirects))
    placed = saved(pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    nodes, links = numbered(edges)
    members = connected_components(links).join(nodes, "node")
    members = saved(members.select("url", "root", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    fits = saved(fitting_rules(placed.select("host", "path").unionByName(members.select("host", "path")), rules))
    spread = members.join(fits, ["host", "path"], "left").groupBy("root").agg(
        F.coalesce(F.max(F.col("action") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.max(F.col("action") == "block"), F.lit(False)).alias("blocked"))
    blocked = members.join(spread.filter("blocked AND NOT allowed"), "root").select("url", F.lit(True).alias("by_alias"))
    judged = placed.join(fits, ["host", "path"], "left").join(blocked, "url", "left")
    alias = F.when(F.col("by_alias"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("action", alias).alias("verdict"))
