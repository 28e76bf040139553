"""URL rules with redirect equivalence.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's path; the longest rule (host and path together) wins, ties go to allow, then to the
smaller text. URLs that no rule fits take part in the redirect graph: pages and the targets of their
canonical links and refresh redirects are nodes, connected components make classes of aliases, and a class
that holds a blocked URL blocks its aliases unless it also holds an explicitly allowed one. What nothing
decides is allowed.

Only DataFrame operations run here. Rules are a list on the driver: up to ``INLINE_RULES`` of them are
tested inside the projection, more of them are joined by the host's suffixes.

Defined results: a null URL, or one without "://", has empty host and path, fits no rule and is allowed; an
empty or null html gives no links; repeated rows each get their verdict; a very long page is searched in place,
by one regular expression; an empty table gives an empty result; other columns are ignored, whatever their
names. A fragment names a place within a page, so nodes leave it out. Links are taken as they are written, but
for ampersands: steps up (../) are not resolved, nor is <base>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut
from tidemark.llm.graph import connected_components

INLINE_RULES = 200
LINK_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
LINK_KIND = r"(?i)(rel\s*=\s*[\"']?\s*canonical|http-equiv\s*=\s*[\"']?\s*refresh)"
LINK_HREF = r"(?i)(?:href\s*=\s*[\"']?|[;\"'\s]url\s*=\s*[\"']?)([^\"'>\s]+)"
AMPERSAND = "(?i)&(amp|#38|#x26);"

Rule = tuple[str, str, str]
#: The rules of the registered query.
RULES: list[Rule] = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty for null and for URLs without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path of a URL column."""
    rest = df.withColumn("_rest", after_scheme(F.col(url)))
    host, path = F.regexp_extract("_rest", "^[^/?#]*", 0), F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)
    return rest.withColumn("host", ascii_lower(host)).withColumn("path", path).drop("_rest")


def _fits(host: Column, path: Column, rule: Column) -> Column:
    return ((host == rule["host"]) | F.endswith(host, F.concat(F.lit("."), rule["host"]))) & F.startswith(path, rule["path"])


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0] + r[1]))


def apply_rules(pages: DataFrame, rules: Sequence[Rule], inline: int = INLINE_RULES) -> DataFrame:
    """Add rule and rule_verdict (null where none fits) to rows that have host and path."""
    ordered = _ordered(rules)
    if not ordered:
        return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    if len(ordered) <= inline:
        listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in ordered])
        best = F.get(F.filter(listed, lambda r: _fits(F.col("host"), F.col("path"), r)), F.lit(0))
        return pages.withColumn("_best", best).withColumn("rule", F.concat("_best.host", "_best.path")).withColumn("rule_verdict", F.col("_best.verdict")).drop("_best")
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, p, v, k) for k, (h, p, v) in enumerate(ordered)], "_rh string, _rp string, _rv string, _rk int")
    pairs = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = pairs.withColumn("_suffix", F.explode(suffixes)).join(table, F.col("_suffix") == F.col("_rh")).filter(F.startswith("path", F.col("_rp")))
    best = hits.groupBy("host", "path").agg(F.min(F.struct("_rk", "_rh", "_rp", "_rv")).alias("_best"))
    joined = pages.join(best, ["host", "path"], "left")
    return joined.withColumn("rule", F.concat("_best._rh", "_best._rp")).withColumn("rule_verdict", F.col("_best._rv")).drop("_best")


def with_node(df: DataFrame, url: str, name: str) -> DataFrame:
    """Add a URL's node: scheme and host in lower case, without fragment."""
    staged = df.withColumn("_head", F.regexp_extract(url, "^[^#]*?://[^/?#]*", 0)).withColumn("_bare", F.regexp_extract(url, "^[^#]*", 0))
    return staged.withColumn(name, F.concat(ascii_lower(F.col("_head")), F.substring("_bare", F.length("_head") + 1, F.length("_bare")))).drop("_head", "_bare")


def unescaped(href: Column) -> Column:
    """A link with the ways to write & in HTML read back."""
    return F.regexp_replace(href, AMPERSAND, "&")


def links_of(pages: DataFrame) -> DataFrame:
    """(u, v): pages' URLs and the absolute URLs that their canonical links and refresh redirects name."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(LINK_TAG), 0), lambda t: F.rlike(t, F.lit(LINK_KIND)))
    found = pages.select("url", F.explode(tags).alias("tag")).select("url", unescaped(F.regexp_extract("tag", LINK_HREF, 1)).alias("href")).filter("href != '' and url is not null")
    found = found.withColumn("_scheme", F.regexp_extract("url", "^[^:/?#]*", 0)).withColumn("_root", F.regexp_extract("url", "^[^#]*?://[^/?#]*", 0))
    found = found.withColumn("_folder", F.regexp_extract(F.regexp_extract("url", "^[^?#]*", 0), "^.*://.*/", 0))
    full = (
        F.when(F.instr("href", "://") > 0, F.col("href"))
        .when(F.startswith("href", F.lit("//")), F.concat("_scheme", F.lit(":"), "href"))
        .when(F.startswith("href", F.lit("/")), F.concat("_root", "href"))
        .otherwise(F.concat(F.when(F.col("_folder") != "", F.col("_folder")).otherwise(F.concat("_root", F.lit("/"))), "href"))
    )
    return found.select(F.col("url").alias("u"), full.alias("v"))


def judge(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, component of pages (page_id, url, html).

    edges: further (u, v) redirects by URL, of a crawl log say.
    """
    links = links_of(pages)
    if edges is not None:
        links = links.unionByName(edges.select("u", "v"))
    links = cut(links)
    members = connected_components(with_node(with_node(links, "u", "_u"), "v", "_v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    seen = with_node(apply_rules(with_parts(pages.select("page_id", "url")), rules), "url", "_node")
    ends = with_parts(members, "node")
    marks = apply_rules(ends, rules).groupBy("component").agg(
        F.max((F.coalesce(F.col("rule_verdict"), F.lit("")) == "block").cast("int")).alias("_block"),
        F.max((F.coalesce(F.col("rule_verdict"), F.lit("")) == "allow").cast("int")).alias("_allow"),
    )
    decided = cut(members.join(marks, "component").select(F.col("node").alias("_n"), "component", "_block", "_allow"))
    joined = seen.join(decided, F.col("_node") == F.col("_n"), "left")
    inherited = F.when((F.coalesce(F.col("_block"), F.lit(0)) == 1) & (F.coalesce(F.col("_allow"), F.lit(0)) == 0), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", inherited).alias("verdict"), "component")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


_SQL_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_node(x: str) -> str:
    head = f"regexp_extract({x}, '^[^#]*?://[^/?#]*')"
    return f"{_SQL_LOW.format(head)} || substr(regexp_extract({x}, '^[^#]*'), len({head}) + 1)"


_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SQL_SPLIT = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"
_SQL_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END AS rest"
_SQL_BEST = "(SELECT {0} FROM rules r WHERE (x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p) ORDER BY len(r.h || r.p) DESC, r.v <> 'allow', r.h || r.p LIMIT 1)"

OP10_SQL = f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {_SQL_RULES}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '{LINK_TAG}')) AS tag FROM pages WHERE url IS NOT NULL),
hrefs AS (SELECT url, regexp_replace(regexp_extract(tag, '{LINK_HREF.replace("'", "''")}', 1), '{AMPERSAND}', '&', 'g') AS href FROM tags WHERE regexp_matches(tag, '{LINK_KIND.replace("'", "''")}')),
parts AS (SELECT url, href, regexp_extract(url, '^[^:/?#]*') AS scheme, regexp_extract(url, '^[^#]*?://[^/?#]*') AS root,
  regexp_extract(regexp_extract(url, '^[^?#]*'), '^.*://.*/') AS folder FROM hrefs WHERE href <> ''),
full_ AS (SELECT url, CASE WHEN instr(href, '://') > 0 THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN starts_with(href, '/') THEN root || href
  ELSE (CASE WHEN folder <> '' THEN folder ELSE root || '/' END) || href END AS target FROM parts),
edges AS (SELECT {_sql_node("url")} AS u, {_sql_node("target")} AS v FROM full_),
both_ AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(a, b) AS (SELECT u, u FROM both_ UNION SELECT r.a, e.v FROM reach r JOIN both_ e ON r.b = e.u),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
ends AS (SELECT node, component, {_SQL_REST.format("node")} FROM comp),
ruled AS (SELECT x.component, {_SQL_BEST.format("r.v")} AS v FROM (SELECT node, component, {_SQL_SPLIT} FROM ends) x),
marks AS (SELECT component, coalesce(bool_or(v = 'block'), false) AND NOT coalesce(bool_or(v = 'allow'), false) AS bad FROM ruled GROUP BY component),
raw AS (SELECT page_id, url, {_SQL_REST.format("url")} FROM pages),
split_ AS (SELECT page_id, {_sql_node("url")} AS node, {_SQL_SPLIT} FROM raw),
told AS (SELECT x.page_id, x.host, x.path, x.node, {_SQL_BEST.format("r.h || r.p")} AS rule, {_SQL_BEST.format("r.v")} AS v FROM split_ x)
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.v, CASE WHEN m.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM told t LEFT JOIN comp c ON t.node = c.node LEFT JOIN marks m ON c.component = m.component
"""
