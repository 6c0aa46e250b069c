"""URL filters with redirect equivalence.

Rules name a host (with its subdomains) and a path prefix. Pages that no rule fits take
the decision of their aliases: connected components over redirect edges (meta refresh),
canonical-link edges (link rel=canonical) and the edge from each url to its canonical spelling (scheme, www. or m., query,
fragment, trailing slash and .html dropped). All links and refreshes of a page count; relative targets
are resolved against the page's url (base elements aside). In a component an explicit allow takes precedence
over a block; without either, the page is allowed.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, has no
alias and is allowed; equal urls get equal verdicts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, link_components

#: (verdict, host, path), fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SCHEME = r"^[a-z][a-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s)[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def spelling(url: Column) -> Column:
    """Canonical spelling of a url: lower-case host without www. or m., and the path without .html or trailing slash."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    return F.when(url.contains("://"), F.concat(host, F.regexp_replace(path_of(url), r"(?:\.html|/)$", "")))


def _declared(html: Column) -> Column:
    """Targets of all canonical links and refreshes, as written."""
    each = lambda tag, value: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, value, 1))
    link = each(r"(?i)<link\b[^>]*rel=[\"']?canonical[^>]*>", r"(?i)href=[\"']?([^\"'\s>]+)")
    refresh = each(r"(?i)<meta\b[^>]*http-equiv=[\"']?refresh[^>]*>", r"(?i)url=[\"']?([^\"'\s>]+)")
    return F.array_distinct(F.filter(F.concat(link, refresh), lambda x: x != ""))


def _steps(path: Column) -> Column:
    """The path with its steps . and .. carried out."""
    none = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.regexp_replace(path, r"^/", ""), "/"), none, step), "/"))


def resolved(target: Column, url: Column) -> Column:
    """A target as an absolute url, without query and fragment if it was relative to ``url``; null for other schemes (mailto:) and where neither has a host."""
    here = F.when(url.contains("://"), F.regexp_extract(url, r"^([\s\S]*?://[^/?#]*)", 1))
    file = F.regexp_extract(target, r"^([^?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"^([\s\S]*/)", 1)
    return (
        F.when(target.rlike(r"^(?i:[a-z][a-z0-9+.-]*)?://"), target)
        .when(target.rlike(r"^(?i:[a-z][a-z0-9+.-]*):"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(here, r"^([\s\S]*?:)//", 1), target))
        .when(file == "", F.concat(here, path_of(url)))
        .when(target.startswith("/"), F.concat(here, _steps(file)))
        .otherwise(F.concat(here, _steps(F.concat(folder, file))))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): url spellings that a page declares equal. Spellings are the nodes, so equal spellings need no edge."""
    own = pages.select("url", F.explode(_declared(F.col("html"))).alias("to"))
    return own.select(spelling(F.col("url")).alias("src"), spelling(resolved(F.col("to"), F.col("url"))).alias("dst"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component) for every row."""
    url = F.col("url")
    found = pages.select("page_id", "url", F.when(url.contains("://"), host_of(url)).otherwise("").alias("host"), F.when(url.contains("://"), path_of(url)).otherwise("").alias("path"), spelling(url).alias("node"))
    found = found.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    parts = link_components(alias_edges(pages))
    # rows without a spelling have no alias and would all meet on one null key
    named, alone = found.where("node is not null"), found.where("node is null")
    # one row a spelling; copies of a url count once before anything meets
    said = lambda verdict: F.max(F.coalesce(F.col("r.verdict") == verdict, F.lit(False))).alias(verdict)
    nodes = named.groupBy("node").agg(said("allow"), said("block")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = nodes.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    out = named.join(nodes.select("node", "component").join(whole, "component"), "node", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("block") & ~F.col("allow"), "block").otherwise("allow"))
    cols = ["page_id", "url", "host", "path", F.col("r.rule").alias("rule")]
    return out.select(*cols, verdict.alias("verdict"), "component").unionByName(alone.select(*cols, F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("component")))


def op3_urls(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


_RULE_SQL = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))
_SPELL = "CASE WHEN contains({u}, '://') THEN regexp_replace(translate(regexp_extract({u}, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(?:www|m)\\.', '') || regexp_replace(regexp_extract({u}, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '(?:\\.html|/)$', '') END"
SQL = f"""
WITH RECURSIVE base AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    {_SPELL.format(u="url")} AS node
  FROM pages),
ruled AS (SELECT *, CASE {_RULE_SQL} END AS r FROM base),
declared AS (
  SELECT node AS src, regexp_extract(regexp_extract(html, '(?i)<link\\b[^>]*rel=["'']?canonical[^>]*>'), '(?i)href=["'']?([^"''\\s>]+)', 1) AS u FROM ruled
  UNION SELECT node, regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*http-equiv=["'']?refresh[^>]*>'), '(?i)url=["'']?([^"''\\s>]+)', 1) FROM ruled),
edge AS (SELECT src, {_SPELL.format(u="u")} AS dst FROM declared WHERE contains(u, '://') AND src IS NOT NULL),
both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
reach(node, root) AS (
  SELECT node, node FROM ruled WHERE node IS NOT NULL UNION SELECT src, src FROM both_ways UNION SELECT dst, dst FROM both_ways
  UNION SELECT b.dst, r.root FROM reach r JOIN both_ways b ON b.src = r.node),
part AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
said AS (SELECT p.component, max(CASE WHEN starts_with(r, 'allow') THEN 1 ELSE 0 END) AS allow, max(CASE WHEN starts_with(r, 'block') THEN 1 ELSE 0 END) AS block
  FROM ruled JOIN part p ON ruled.node = p.node GROUP BY p.component)
SELECT page_id, host, path, substr(r, 7) AS rule,
  coalesce(substr(r, 1, 5), CASE WHEN said.block = 1 AND said.allow = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN part ON ruled.node = part.node LEFT JOIN said ON part.component = said.component
"""
