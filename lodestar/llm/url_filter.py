"""URL filter with redirect equivalence, in DataFrame operations only.

1. *Rules.* A rule fits a host and all its subdomains where the path starts with the rule's. Every distinct address is
   taken apart into its host's suffixes and, of the lengths that rules of that suffix have, its path's prefixes;
   these meet the rules by equality, and the longest rule wins.
2. *Links.* Redirects (a table of pairs, and pages that refresh to another address at once) and canonical links
   of the pages' heads join addresses that are one document's. Only pages with such tags are taken apart.
3. *Components.* Addresses reachable over links are aliases: large-star and small-star rounds over written tables.
4. *Verdicts.* An address with a rule has that rule's verdict. Any other has its component's: allow if a member is
   allowed by a rule, else block if one is blocked by a rule, else the default.

Addresses are one node when they differ in scheme (of http and https), default port, letter case of the host, or
fragment. Only addresses with links are nodes, so pages join a component table that is small next to them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import let

from .shared import components, cut

ALLOW, BLOCK = "allow", "block"

#: What a page's markup is freed of before its tags are read.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<textarea\b.*?</textarea\s*>"
#: Tags that may hold a link.
TAGS = r"(?i)<(?:link|meta)\b[^>]*>"


def lowered(c: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> Column:
    """(host, path, node) of an address.

    Host and path as the contract has them: after the first ``://``, the host up to ``/``, ``?``, ``#`` or the end, in
    small letters, the path from there up to ``?``, ``#`` or the end; both empty without a ``://``. The node is the host
    without a default port, path (``/`` if empty) and query, null without a host.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    cut_up = F.struct(lowered(part(1)).alias("host"), part(2).alias("path"), part(3).alias("query"))

    def with_node(u: Column) -> Column:
        place = F.concat(F.regexp_replace(u["host"], r":(?:80|443)$", ""), F.when(u["path"] == "", F.lit("/")).otherwise(u["path"]), u["query"])
        return F.named_struct(*(x for k, v in (("host", u["host"]), ("path", u["path"]), ("node", F.when(u["host"] != "", place))) for x in (F.lit(k), v)))

    return let(cut_up, with_node)


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if it is not there."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(F.regexp_replace(found, r"^[\"']|[\"']$|[\t\n\r\x0B\f]", ""))


def resolved(at: Column, href: Column) -> Column:
    """``href`` as a full address, seen from ``at`` (an address split); dot segments stay. Null for none and for a mere fragment."""
    base = F.concat(F.lit("http://"), at["host"])
    folder = F.regexp_replace(at["path"], r"[^/]*$", "")

    def seen(h: Column) -> Column:
        other = F.when((h == "") | h.startswith("#"), F.lit(None).cast("string")).when(h.rlike(r"^(?i)https?://"), h)
        other = other.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")).when(h.startswith("//"), F.concat(F.lit("http:"), h))
        other = other.when(h.startswith("/"), F.concat(base, h)).when(h.startswith("?"), F.concat(base, at["path"], h))
        return other.otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), h))

    return let(F.regexp_replace(href, r"(?i)&amp;", "&"), seen)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes that canonical links and refreshes of the pages join. Pages without both an address and markup have none."""
    rows = pages.select(F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
    tags = rows.select(split_url(F.col("url")).alias("at"), F.explode(F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(TAGS), F.lit(0))).alias("tag"))
    link = F.lower(F.substring("tag", 2, 4)) == "link"
    canonical = link & _attribute(F.col("tag"), "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = ~link & (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh")
    tags = tags.select("at", "tag", F.when(canonical, "c").when(refresh, "r").alias("kind")).where("kind IS NOT NULL")
    target = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^\s*[0-9.]+\s*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1)
    href = F.when(F.col("kind") == "c", _attribute(F.col("tag"), "href")).otherwise(F.trim(target))
    ends = tags.select("at", resolved(F.col("at"), href).alias("to")).where("to IS NOT NULL")
    return ends.select(F.col("at.node").alias("a"), split_url(F.col("to"))["node"].alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def rule_table(spark, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a table; a rule is a host followed by a path's beginning."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def fitted(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) that a rule fits: the longest one.

    Of rules as long the one of the longer host wins; a rule listed under both verdicts allows.
    """
    rules = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK))
    rules = rules.select(lowered(F.regexp_extract("rule", r"^[^/]*", 0)).alias("at"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("begin"), "rule", "verdict")
    rules = rules.groupBy("at", "begin").agg(F.min(F.struct("verdict", "rule")).alias("r")).select("at", "begin", "r.rule", "r.verdict")
    lengths = rules.select("at", F.length("begin").alias("long")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = addresses.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("at"))
    parts = parts.join(lengths, "at").where(F.length("path") >= F.col("long")).withColumn("begin", F.expr("substring(path, 1, long)"))
    found = parts.join(rules, ["at", "begin"])
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("at").alias("m"), "rule", "verdict")).alias("r"))
    return best.select("host", "path", "r.rule", "r.verdict")


def url_filter(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = ALLOW) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict, component (least address of its aliases, if it has any).

    ``redirects`` holds pairs (from_url, to_url) of full addresses. A null url, or one without ``://``, has no host, no
    rule, no aliases and the default verdict. Repeated pages and ids are rows of their own, with equal verdicts for
    equal urls. No pages give no rows. Columns beside the three named are not read.
    """
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    own = own.withColumn("u", split_url(F.col("url"))).select("page_id", "url", "u.host", "u.path", "u.node")
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        ends = redirects.select(split_url(F.col("from_url"))["node"].alias("a"), split_url(F.col("to_url"))["node"].alias("b"))
        links = links.unionByName(ends.where("a IS NOT NULL AND b IS NOT NULL"))
    alike = cut(components(cut(links.where("a <> b").distinct())))
    # a node's host and path are read off it, so members that are no pages of the table count too
    nodes = alike.select("node", "root", split_url(F.concat(F.lit("http://"), "node")).alias("u")).select("node", "root", "u.host", "u.path")
    # a page's own host and path may differ from its node's in port and an empty path
    ruled = cut(fitted(own.select("host", "path").unionByName(nodes.select("host", "path")), rules))
    stated = nodes.join(ruled, ["host", "path"]).groupBy("root").agg(F.min("verdict").alias("shared"))  # allow comes first
    passed = alike.join(stated, "root", "left").select("node", F.col("root").alias("component"), "shared")
    # both grow with the pages, and addresses compress so well that a file's size says little: never broadcast them
    out = own.join(ruled.hint("merge"), ["host", "path"], "left").join(passed.hint("merge"), "node", "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", "shared", F.lit(default)).alias("verdict"), "component")
