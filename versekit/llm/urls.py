"""URL filters by redirect equivalence (DataFrame and SQL functions only).

A rule is ``(action, host, path)``; it fits its host and all subdomains where
the url's path starts with the rule's, and the longest rule (host + path) wins;
between rules of one length an allow rule wins.  Urls that redirect to each
other or name one canonical url are aliases: edges come from the pages' html
(``<link rel="canonical">`` and ``<meta http-equiv="refresh">``) or from an edge
table, and connected components over them make the alias classes.  A url
without a rule of its own is blocked if a url of its class is blocked by a rule
and none is allowed by one (an explicit allow takes precedence over propagated
blocks); otherwise it is allowed.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is no alias, so it is allowed; repeated rows are judged alike
and stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versekit.llm.components import components
from versekit.llm.store import discard, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest rule list that may be written into a query as literals.
MAX_RULES = 5_000


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    h = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(h, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Key of a url among its aliases: host, path and query; scheme and fragment do not count."""
    rest = _rest(url)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def rule_columns(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, action) of the winning rule, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into one expression")
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow", r[1], r[2]))
    name = action = F.lit(None).cast("string")
    for act, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def html_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) urls of canonical links and meta refreshes, relative targets resolved."""
    src, text = F.col("_url"), F.col("_html")
    linked = (pages.select(F.col(url).alias("_url"), F.col(html).alias("_html"))
              .filter(text.isNotNull() & src.isNotNull() & text.rlike(r"(?i)\b(canonical|refresh)\b")))
    tag = F.explode(F.regexp_extract_all(text, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1))
    # a page's host, scheme and folder are columns before its tags are taken apart, so that no expression repeats them
    place = F.regexp_replace(F.regexp_replace(path_of(src), r"^/", ""), r"[^/]*$", "")
    linked = linked.select("_url", "_html", host_of(src).alias("_host"), F.regexp_extract(src, r"^([^:]*)://", 1).alias("_scheme"), place.alias("_place"))
    tags = linked.select("_url", "_host", "_scheme", "_place", tag.alias("tag")).filter(F.col("tag").rlike(
        r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b|^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    href = F.coalesce(
        *[F.nullif(F.regexp_extract("tag", p, 1), F.lit("")) for p in (
            r"(?is)^<link\b.*?\bhref\s*=\s*\"([^\"]*)\"", r"(?is)^<link\b.*?\bhref\s*=\s*'([^']*)'",
            r"(?is)^<link\b.*?\bhref\s*=\s*([^\s\"'>]+)", r"(?is)\bcontent\s*=\s*[\"'][^\"']*?\burl\s*=\s*([^\"'\s>]+)")])
    to, host, scheme = F.col("_to"), F.col("_host"), F.col("_scheme")
    absolute = (F.when(F.locate("://", to) > 0, to)
                .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
                .when(to.startswith("/"), F.concat(scheme, F.lit("://"), host, to))
                .otherwise(F.concat(scheme, F.lit("://"), host, F.lit("/"), F.col("_place"), to)))
    return (tags.select("_url", "_host", "_scheme", "_place", F.trim(href).alias("_to")).filter("_to IS NOT NULL")
            .select(src.alias("src"), absolute.alias("dst")))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url",
               html: str | None = "html", redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_class) of every page.

    ``redirects``: further (src, dst) url pairs, e.g. from crawl logs.
    ``alias_class`` is the smallest url key of the page's alias class (null for
    a page without aliases).
    """
    u = F.col("_url")
    base = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"))
    rule, action = rule_columns(rules, F.col("host"), F.col("path"))
    judged = (base.select("_id", host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("_node"))
              .withColumn("rule", rule).withColumn("_action", action))
    links = [html_edges(pages, url, html)] if html else []
    links += [redirects.select("src", "dst")] if redirects is not None else []
    if not links:
        return judged.select(F.col("_id").alias("page_id"), "host", "path", "rule",
                             F.coalesce("_action", F.lit(default)).alias("verdict"),
                             F.lit(None).cast("string").alias("alias_class"))
    all_links = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    # links are written before they become keys: one expression over the html for both would be too long to compile
    all_links, path = keep(all_links, "links")
    ends = all_links.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v"))
    classes, _ = keep(components(ends), "alias")
    discard(pages.sparkSession, path)
    # an alias' rule follows from its key, whether or not the url is a page itself
    key = F.concat(F.lit("x://"), F.col("node"))
    _, ruled = rule_columns(rules, host_of(key), path_of(key))
    said = classes.select("root", ruled.alias("a")).filter("a IS NOT NULL")
    verdicts = said.groupBy("root").agg(F.max((F.col("a") == "allow").cast("int")).alias("ok"),
                                        F.max((F.col("a") == "block").cast("int")).alias("bad"))
    by_class = (classes.join(verdicts, "root", "left")
                .select(F.col("node").alias("_node"), F.col("root").alias("alias_class"),
                        F.when((F.col("bad") == 1) & (F.coalesce("ok", F.lit(0)) == 0), F.lit("block")).alias("_passed")))
    out = judged.join(by_class, "_node", "left")
    return out.select(F.col("_id").alias("page_id"), "host", "path", "rule",
                      F.coalesce("_action", "_passed", F.lit(default)).alias("verdict"), "alias_class")


#: What the rules alone decide of ``pages``, in DuckDB SQL; the given pages hold no canonical link and no refresh, so no class decides.
ORACLE = """
WITH r(action, h, p) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
s AS (SELECT i, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
f AS (SELECT s.i, r.action, r.h || r.p AS rule,
             row_number() OVER (PARTITION BY s.i ORDER BY length(r.h) + length(r.p) DESC, r.action, r.h, r.p) AS k
      FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM s LEFT JOIN f ON f.i = s.i AND f.k = 1
"""
