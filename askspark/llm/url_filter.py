"""URL rules that also hold for aliases: redirects and canonical links make one group of addresses out of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askspark.llm.common import UPPER
from askspark.llm.components import connected_components

#: (host and path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
Rules = list[tuple[str, str]]


def _parts(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", group)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(_parts(url, 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return _parts(url, 2)


def node_of(url: Column) -> Column:
    """The address without its fragment, host lower-cased; null where there is no host."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), path_of(url), F.coalesce(_parts(url, 3), F.lit(""))))


def canonical_of(url: Column) -> Column:
    """The address that plain variants of a page redirect to: https, no ``www.`` or ``m.``, no tracking parameters, no
    ``.html`` or slash at the end."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/+)$", "")
    query = F.regexp_replace(F.regexp_replace(_parts(url, 3), r"(?<=[?&])(utm_[a-z]+|ref)=[^&]*(&|$)", ""), r"[?&]$", "")
    return F.when(host_of(url) != "", F.concat(F.lit("https://"), host, path, query))


def resolved(target: Column, url: Column) -> Column:
    """``target`` as an address, where it is relative to the page ``url``: ``//host/x``, ``/x``, ``x``, ``../x``, ``?x`` or
    ``#x``. Null for a relative one on a page without a host; one with a scheme, or empty, stays as it is."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    top = F.concat(scheme, F.lit("://"), host_of(url))
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", 2)
    folder = F.when(path_of(url) == "", F.lit("/")).otherwise(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1))
    steps = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), "/")
    go = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    done = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), go)
    end = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(done) > 0), F.lit("/")).otherwise(F.lit(""))
    whole = (
        F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(top, path_of(url), target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(top, F.lit("/"), F.array_join(done, "/"), end, rest))
    )
    return F.when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(host_of(url) != "", whole)


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (``a``, ``b``) of addresses that are the same page: the redirect to the plain form, ``<link
    rel="canonical">`` and ``<meta http-equiv="refresh">`` of the page, each with its own plain form. Relative targets
    are resolved against the page's own address; ``<base>`` is not read. Targets of schemes without ``://`` (``mailto:x``), and
    relative ones on a page without a host, name no page and give no edge."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    link = F.regexp_extract(html, r"""(?is)<link\b(?=[^<>]*\brel\s*=\s*["']?canonical\b)[^<>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b(?=[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^<>]*\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    pages = pages.select(url.alias("url"), link.alias("link"), refresh.alias("refresh"))
    pages = pages.select("url", *(resolved(F.col(c), F.col("url")).alias(c) for c in ("link", "refresh")))
    targets = F.array(F.struct(F.col("url").alias("x")), F.struct(F.col("link").alias("x")), F.struct(F.col("refresh").alias("x")))
    seen = pages.select(node_of(F.col("url")).alias("page"), F.explode(targets).alias("t"))
    seen = seen.select("page", node_of(F.col("t.x")).alias("node"), canonical_of(F.col("t.x")).alias("plain"))
    edge = F.explode(F.array(F.struct(F.col("page").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("plain").alias("b")))).alias("e")
    return seen.select(edge).select("e.a", "e.b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()


def own_rule(host: Column, path: Column, rules: Rules) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, null fields without one; at the same length an
    allowing rule goes first."""
    fits = []
    for rule, verdict in rules:
        r_host, slash, rest = rule.partition("/")
        ok = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(slash + rest)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(verdict == "allow").alias("first"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def filter_urls(
    pages: DataFrame, rules: Rules, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: the id, ``host``, ``path``, ``rule`` (the longest that fits, or null), ``verdict`` and
    ``component`` (smallest address of the group, null for an address without aliases).

    The verdict is that of the address's own rule. An address without a rule follows its group of aliases: allowed if any
    of them is explicitly allowed, else blocked if any is blocked, else allowed. ``edges`` (a, b) replaces the aliases
    found in the pages. A null url, or one without ``://``, has an empty host, no aliases and is allowed. Repeated rows
    give repeated rows. Only DataFrame operations; nothing is collected.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("own", own_rule(F.col("host"), F.col("path"), rules))
    judged = judged.select("id", node_of(F.col("url")).alias("node"), "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("verdict"))
    groups = connected_components(edges if edges is not None else alias_edges(pages, url_col, html_col))
    # addresses that only redirects name have rules too
    node = F.col("node")
    ruled = groups.withColumn("own", own_rule(host_of(node), path_of(node), rules)["verdict"])
    of_group = ruled.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    followed = groups.join(of_group, "component")
    theirs = F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(followed, "node", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", theirs).alias("verdict"), "component",
    )
