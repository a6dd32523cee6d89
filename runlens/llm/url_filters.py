"""URL filters: rules by host and path, and verdicts passed on to aliases.

Redirects and canonical links say that two URLs are one resource. Distributed connected
components over these edges give each URL its group. A page without a rule of its own takes
the verdict of its group: allow if any URL of the group is allowed by a rule, else
block if any is blocked by one, else allow.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import components, written

# Rules become one expression of the plan; a list of this length at most.
MOST_RULES = 1_000

SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest rule is tested first, so it is put on last.
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, in quotes or bare, in a tag's text; empty if there is none."""
    quoted = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*(F.regexp_extract(tag, quoted, i) for i in (1, 2, 3))))


def plain_text(value: Column) -> Column:
    """An attribute's value with its character references decoded: numbers and the five names of XML."""

    def decoded(token: Column) -> Column:
        number = F.coalesce(
            F.conv(F.nullif(F.regexp_extract(token, r"^&#(\d{1,7});$", 1), F.lit("")), 10, 10),
            F.conv(F.nullif(F.regexp_extract(token, r"(?i)^&#x([0-9a-f]{1,6});$", 1), F.lit("")), 16, 10),
        ).cast("long")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32")
        named = F.lower(token)
        for name, text in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            char = F.when(named == f"&{name};", text).otherwise(char)
        return F.coalesce(char, token)

    # Each reference is decoded once: ``&amp;#47;`` is the text ``&#47;``.
    tokens = F.regexp_extract_all(value, F.lit(r"(?is)(&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]+);|&|[^&]+)"), 1)
    return F.when(value.contains("&"), F.array_join(F.transform(tokens, decoded), "")).otherwise(value)


def without_dots(path: Column) -> Column:
    """A path that starts with ``/``, with the segments ``.`` and ``..`` worked out."""
    parts = F.split(path, "/")
    done = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))),
    )
    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def absolute(link: Column, base: Column) -> Column:
    """A link as a URL, resolved against its base as RFC 3986 says, without its fragment.

    Null if the link has a scheme without ``//`` (``mailto:``, ``javascript:``), or has none
    and the base is no URL with a scheme and ``//``.
    """
    link = F.regexp_replace(link, "(?s)#.*$", "")
    site = F.regexp_extract(base, rf"(?s)^({SCHEME}://[^/?#]*)", 1)
    path = F.regexp_extract(base, rf"(?s)^{SCHEME}://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, rf"(?s)^{SCHEME}://[^/?#]*[^?#]*(\?[^#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1))
    full = (
        F.when(link.rlike(f"^{SCHEME}://"), link)
        .when(link.rlike(f"^{SCHEME}:") | (site == ""), None)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, f"^({SCHEME}:)", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(link == "", F.concat(site, path, query))
        .otherwise(F.concat(site, folder, link))
    )
    parts = [F.regexp_extract(full, rf"(?s)^({SCHEME}://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3)]
    return F.concat(parts[0], without_dots(parts[1]), parts[2])


def node_of(url: Column) -> Column:
    """The name of a URL in groups: no fragment, scheme and host in small letters.

    Spellings with one name have one host and path, so one rule. Text that is no URL
    with a scheme and ``//`` is its own name.
    """
    pattern = rf"(?s)^({SCHEME}://)((?:[^/?#]*@)?)([^/?#]*)([^#]*)"
    scheme, user, host, rest = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3, 4))
    small = [F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") for part in (scheme, host)]
    return F.when(scheme == "", url).otherwise(F.concat(small[0], user, small[1], rest))


def edges_of(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Columns ``a`` and ``b``: names of URLs joined by a canonical link or an immediate redirect.

    A page without such a tag costs two searches for fixed words. Links are resolved against
    the page's ``base`` tag, if it has one, else against its URL.
    """
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).filter(
        F.col("url").isNotNull() & (F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv"))
    )
    tags = rows.select(
        "url",
        F.regexp_extract_all("html", F.lit(r"(?is)(<base\s[^>]*>)"), 1).alias("bases"),
        F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("tag"),
    )
    tag = F.col("tag")
    canonical = F.when(F.lower(attribute(tag, "rel")) == "canonical", attribute(tag, "href"))
    content = F.when(F.lower(attribute(tag, "http-equiv")) == "refresh", attribute(tag, "content"))
    redirect = F.trim(F.regexp_extract(content, r"(?is)^\s*\d+\s*[;,]\s*url\s*=\s*['\"]?([^'\"]+)", 1))
    # An explode keeps Spark from working out a link anew in each place that uses it.
    link = F.explode(F.array(F.when(tag.rlike("(?is)^<link"), canonical).otherwise(redirect)))
    found = tags.select("url", "bases", link.alias("link")).filter("link <> ''")
    hrefs = F.filter(F.transform("bases", lambda t: attribute(t, "href")), lambda href: href != "")
    found = found.select("url", "link", F.explode(F.array(F.get(hrefs, F.lit(0)))).alias("base"))
    base = F.coalesce(absolute(address(F.col("base")), F.col("url")), F.col("url"))
    found = found.select("url", "link", F.explode(F.array(base)).alias("base"))
    found = found.select("url", F.explode(F.array(absolute(address(F.col("link")), F.col("base")))).alias("b"))
    found = found.select(F.explode(F.array(F.struct(node_of(F.col("url")).alias("a"), node_of(F.col("b")).alias("b")))).alias("e"))
    return found.select("e.a", "e.b").filter("b IS NOT NULL AND a <> b").distinct()


def address(value: Column) -> Column:
    """The URL that an attribute states: references decoded, no line breaks, no blanks around."""
    return F.trim(F.regexp_replace(plain_text(value), r"[\t\r\n]", ""))


def judged(
    pages: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """One row per page: host, path, the rule that fits, the verdict, and its group.

    ``redirects`` may add edges (columns ``a``, ``b``, whole URLs) from a crawl's log. URLs that
    differ in their fragment, or in the case of scheme and host, are one in groups. URLs without
    ``://`` and null URLs have an empty host and path, and no rule. Null ids and repeated
    rows keep their rows; other columns are ignored.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        node_of(F.col(url)).alias("node"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", text.alias("rule"), verdict.alias("own"))
    edges = edges_of(pages, url, html)
    if redirects is not None:
        more = redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        edges = edges.unionByName(more.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    groups = components(edges, "url-groups")
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    verdicts = groups.groupBy("root").agg(
        F.when(F.max(own.eqNullSafe("allow")), "allow").when(F.max(own.eqNullSafe("block")), "block").alias("passed_on")
    )
    groups = written(groups.join(verdicts, "root").select("node", F.col("root").alias("alias_of"), "passed_on"), "url-verdicts")
    return rows.join(groups, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", "passed_on", F.lit("allow")).alias("verdict"),
        "alias_of",
    )


def rules_from(lines: Sequence[str]) -> list[Rule]:
    """Rules from lines such as ``block example.com/de/``."""
    return [Rule(*re.fullmatch(r"(allow|block) ([^/]+)(/.*)", line).groups()) for line in lines]
