"""URL filters by rules and redirect equivalence, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import land

#: Characters in which A-Z become a-z; other letters stay.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tags that name another address of the same page, and the attribute that holds it. A tag ends at the next angle bracket.
_CANONICAL = r"""(?i)<link\b(?=[^<>]*\brel\s*=\s*(?:"[^"<>]*|'[^'<>]*)?\bcanonical\b)[^<>]*\bhref\s*=\s*["']?([^"'\s<>]+)"""
_REFRESH = r"""(?i)<meta\b(?=[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^<>]*\bcontent\s*=\s*["']?[^"'<>]*?\burl\s*=\s*["']?([^"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule's text, or null. ``rules``: ("allow" or "block", "host/path start"); a short list of settings."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: len(x[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _key(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null without a host."""
    host, rest = host_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)``: a page's key and that of its canonical or redirect address, where it names another page.

    All canonical and refresh tags of a page count. Addresses without a scheme are completed from the page's own url. A
    null url or html, a html without such tags and an empty table give no rows; html is read whole, however long.
    """
    own = F.col(url)
    targets = F.flatten(F.array(*(F.regexp_extract_all(html, F.lit(tag), F.lit(1)) for tag in (_CANONICAL, _REFRESH))))
    named = pages.where(F.col(html).rlike(r"(?i)\bcanonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    rows = named.select(own.alias("own"), F.explode(targets).alias("to")).where("to != ''")
    scheme = F.concat(F.regexp_extract("own", r"(?s)^(.*?)://", 1), F.lit(":"))
    to = (
        F.when(F.col("to").rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, "to"))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("//"), host_of(F.col("own")), "to"))
        .otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract("own", r"(?s)^(.*?://[^/?#]*/(?:[^?#]*/)?)", 1), F.lit("")), F.concat(scheme, F.lit("//"), host_of(F.col("own")), F.lit("/"))), "to"))
    )
    return rows.select(_key(F.col("own")).alias("src"), _key(to).alias("dst")).where("src != dst")


def judge(pages: DataFrame, rules: list[tuple[str, str]], edges: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Every page with ``host``, ``path``, ``rule`` and ``verdict``; the html is dropped.

    A page that a rule fits takes that rule's verdict: an explicit allow holds whatever its aliases are. Another page is
    blocked if a page of its component over redirect and canonical links is blocked by a rule; else it is allowed. ``edges``
    are further ``(src, dst)`` urls, such as redirects a crawler has seen; pages that only edges name take part with the
    rules that fit them. Null urls and urls without a host fit no rule, have no aliases and are allowed. Repeated rows
    repeat; other columns pass unchanged, but the four new ones are replaced. An empty table gives no rows.
    """
    action = {rule: kind for kind, rule in rules}
    links = alias_edges(pages, url, html)
    if edges is not None:
        links = links.union(edges.select(_key(F.col("src")).alias("src"), _key(F.col("dst")).alias("dst")).where("src != dst"))
    links = land(links.distinct(), "aliases")
    kind = F.when(F.col("rule").isin(*(r for r, k in action.items() if k == "block")), "block").when(F.col("rule").isNotNull(), "allow")
    keep = [f"`{c}`" for c in pages.columns if c not in (html, "host", "path", "rule", "verdict")]
    judged = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if links.isEmpty():
        return judged.withColumn("verdict", F.coalesce(kind, F.lit("allow")))
    groups = connected_components(links, last_edges=0)  # urls have no bounded length
    as_url = F.concat(F.lit("x://"), F.col("node"))
    bad = groups.withColumn("rule", rule_of(host_of(as_url), path_of(as_url), rules)).where(kind == "block").select("component").distinct()
    blocked = land(groups.join(bad, "component", "left_semi").select(F.col("node").alias("_key")), "blocked")
    spread = judged.withColumn("_key", _key(F.col(url))).join(blocked.withColumn("_blocked", F.lit("block")), "_key", "left")
    return spread.withColumn("verdict", F.coalesce(kind, "_blocked", F.lit("allow"))).drop("_key", "_blocked")
