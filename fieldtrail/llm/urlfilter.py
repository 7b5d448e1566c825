"""URL filter with redirect equivalence: block decisions spread over aliases of a page.

Aliases are URLs joined by redirect (meta refresh) and canonical-link edges (a page can have both; relative ones count), and URLs that differ only in
what servers redirect away: scheme, www. or m. before a name of two labels or more, default port, fragment, tracking parameters, a
closing slash, .html. Explicit rules come first, the longest; others take over their component's decision,
where an allowed member has precedence over a blocked one; a component without a decision is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import stage
from fieldtrail.llm.components import components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]

#: Parameters that only track.
TRACKING = "utm_[a-z_]*|fbclid|gclid|ref|ref_src|mc_cid|mc_eid|igshid"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def alias_key(url: Column) -> Column:
    """The address without what servers redirect away; null without ``://``."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(?:www|m)\.(.*\..*)$", "$1")
    path = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.concat_ws("&", F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)"))))
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat_ws("", host, path, F.when(query != "", F.concat(F.lit("?"), query))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written and worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


_PARTS = r"(?s)^(.*?://[^/?#]*)([^?#]*)(\??[^#]*)"


def _walk(url: Column) -> Column:
    """The address without steps ``.`` and ``..`` in its path."""
    steps = F.split(F.regexp_extract(url, _PARTS, 2), "/")

    def walked(steps: Column) -> Column:
        return F.aggregate(
            F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
            lambda done: F.concat(F.lit("/"), F.array_join(done, "/"), F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(done) > 0), "/").otherwise("")),
        )

    flat = F.concat(F.regexp_extract(url, _PARTS, 1), _let(steps, walked), F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1))
    return F.when(url.rlike(r"(?s)^[^?#]*/\.\.?(/|[?#]|$)"), flat).otherwise(url)


def resolve(base: Column, target: Column) -> Column:
    """``target`` as an address seen from the address ``base``; null if it is null or no address of a page."""

    def join(b: Column) -> Column:
        root, path = b["root"], b["path"]
        return (
            F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), target)
            .when((root == "") | target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(target.startswith("//"), F.concat(F.regexp_extract(root, r"^(.*?:)//", 1), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when((target == "") | target.startswith("#"), F.concat(root, path, b["query"]))
            .when(target.startswith("?"), F.concat(root, path, target))
            .otherwise(F.concat(root, F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")), target))
        )

    base = F.coalesce(base, F.lit(""))
    parts = F.struct(*[F.regexp_extract(base, _PARTS, k).alias(name) for k, name in ((1, "root"), (2, "path"), (3, "query"))])
    return _let(_let(parts, join), _walk)


def linked_urls(url: Column, html: Column) -> Column:
    """The targets of a page's meta refresh and of its canonical link, seen from its base (its url without one); null
    without such a link, and a null for each target that is no address of a page."""
    html = F.coalesce(html, F.lit(""))

    def value(tag: str, attribute: str) -> Column:
        found = F.regexp_extract(F.regexp_extract(html, tag, 0), attribute, 1)
        return F.regexp_replace(found, "&amp;", "&")

    href = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = value(r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)")
    canonical = value(r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>", href)
    own_base = _let(value(r"(?is)<base\b[^>]*>", href), lambda x: F.when(x != "", resolve(url, x)))

    def targets(links: Column) -> Column:
        return F.when(F.size(links) > 0, _let(F.coalesce(own_base, url), lambda base: F.transform(links, lambda x: resolve(base, x))))

    return _let(F.filter(F.array(refresh, canonical), lambda x: x != ""), targets)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(text, verdict); null if none does. Rules are few, so they are one expression."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return reduce(lambda done, f: done.when(*f), fits[1:], F.when(*fits[0])) if fits else F.lit(None).cast("struct<text:string,verdict:string>")


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Per row of ``pages``: id, url, host, path, rule (null if none fits), verdict and alias (least address of the
    component). A null url, or one without ``://``, has empty host and path and no alias, and is allowed. Repeated rows stay; an empty table gives no row; urls and pages are read whole.

    The page table is read twice, each time without a shuffle of html; only addresses are shuffled.
    """
    for r in rules:
        if r.verdict not in ("allow", "block") or re.search(r"[/?#]", r.host):
            raise ValueError(f"not a rule: {r}")
    host, path = host_and_path(F.col(url_col))
    targets = F.transform(linked_urls(F.col(url_col), F.col(html_col)), alias_key) if html_col else F.lit(None).cast("array<string>")
    rows = stage(pages.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), best_rule(host, path, rules).alias("fit"), alias_key(F.col(url_col)).alias("key"), targets.alias("targets")))
    verdict = F.col("fit.verdict")
    keys = rows.where("key IS NOT NULL").groupBy("key").agg(F.max((verdict == "allow").cast("int")).alias("allowed"), F.max((verdict == "block").cast("int")).alias("blocked"))
    links = rows.where("key IS NOT NULL").select(F.col("key").alias("a"), F.explode("targets").alias("b")).where("b IS NOT NULL")
    member = components(links)
    keys = keys.join(member.withColumnRenamed("node", "key"), "key", "left").withColumn("alias", F.coalesce("component", "key"))
    keys = stage(keys.select("key", "alias", F.coalesce("allowed", F.lit(0)).alias("allowed"), F.coalesce("blocked", F.lit(0)).alias("blocked")))
    group = keys.groupBy("alias").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")).where("blocked = 1 AND allowed = 0").select("alias", F.lit("block").alias("taken"))
    # only pages without a rule can take over a decision
    keys = stage(keys.select("key", "alias").join(group, "alias", "left"))
    out = rows.join(keys, "key", "left")
    return out.select(id_col, "url", "host", "path", F.col("fit.text").alias("rule"), F.coalesce("fit.verdict", "taken", F.lit("allow")).alias("verdict"), "alias")
