"""URL filter by a tree of path templates, with DataFrame functions only.

Per host, paths make a tree of segments. First each segment is generalised by its form (leading digits, long
hexadecimal strings). Then, level by level down to the last segment, the children of a node become a wildcard where
the node has many of them or nearly as many as urls, and the child itself is rare: it has fewer than RARE paths,
and too few labels for a verdict of its own. A node of fewer than SPLIT urls is not split further: what is
below it is one wildcard. So there is no bound on the levels, and each has nodes enough to tell something. Below the
first levels chains of nodes with one child take one turn together, so turns are as many as branchings follow each other.

Branches that differ in one segment only are merged if they are statistically alike: the numbers of blocked,
allowed and unlabelled urls of the branches pass a chi-square test of homogeneity at 5 %. Of the merged
branches a template is in, that of most urls counts, and if there is none the template itself. It is rejected where
its smoothed share of labelled blocks, (blocks + 1) / (labels + 2), is ``purity`` at least and SUPPORT of its
urls have labels.

In ``judge`` labels are the verdicts of the rules on the urls that they fit; the method judges the others.
Rules are a short list and become one expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import join_groups, keep

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A node with more children than this, or with MANY_SHARE of its urls as children, has variable ones.
MOST_CHILDREN, MANY_SHARE = 50, 0.9
PURITY = 0.8
#: A child with so many paths is no wildcard; a node with fewer urls has no children.
RARE, SPLIT = 10, 10
#: Turns of one level each before chains are looked for, which costs a job: paths are mostly short, and the templates are the same either way.
FEW_TURNS = 3
#: The least share of a rejected template's urls that have labels.
SUPPORT = 0.1
#: The normal quantile of the test of homogeneity.
Z = 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a url, and its verdict; of equally long ones the first in order."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _form(segment: Column) -> Column:
    """A segment as it is but for leading digits and long hexadecimal strings; what looks like a wildcard is marked."""
    formed = F.when((F.length(segment) >= 16) & segment.rlike("^[0-9a-fA-F]+$"), F.lit("f")).otherwise(F.regexp_replace(segment, "^[0-9]+", "9"))
    return F.when(formed.rlike("^[*=]"), F.concat(F.lit("="), formed)).otherwise(formed)


def _along_chains(now: DataFrame) -> DataFrame:
    """``now`` with each node of SPLIT urls or more moved down to where its urls part or one of them ends.

    The segments that all share are those that the least and the greatest list share. On the way a node has one child,
    which is no wildcard and has all urls, so one turn does for a chain of any length.
    """
    ends = now.groupBy(F.col("host").alias("ch"), F.col("template").alias("ct")).agg(F.min("segments").alias("a"), F.max("segments").alias("b"), F.min(F.size("segments")).alias("least"), F.sum("n").alias("urls"))
    same = F.zip_with(F.slice("a", 1, F.col("least") - 1), F.slice("b", 1, F.col("least") - 1), lambda x, y: x == y)
    shared = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.col("least") - 1).cast("int")
    chains = ends.where((F.col("least") > 1) & (F.col("urls") >= SPLIT)).select("ch", "ct", shared.alias("shared")).where("shared > 0")
    chains = keep(chains, "chains")
    if chains.isEmpty():
        return now
    moved = now.join(chains, (F.col("host") == F.col("ch")) & (F.col("template") == F.col("ct")), "left")
    c = F.coalesce("shared", F.lit(0))
    template = F.when(c > 0, F.concat("template", F.lit("/"), F.array_join(F.slice("segments", F.lit(1), c), "/"))).otherwise(F.col("template"))
    return moved.select("host", "path", "n", "labels", "blocks", F.slice("segments", c + 1, F.size("segments")).alias("segments"), template.alias("template"))


def templates(urls: DataFrame, purity: float = PURITY, most_children: int = MOST_CHILDREN) -> DataFrame:
    """(host, path, template, n, labels, blocks) of each distinct path of ``urls(host, path, label)``; label is block, allow or null."""
    label = F.col("label")
    counts = [F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"), F.sum((label == "block").cast("long")).alias("blocks")]
    paths = urls.groupBy("host", "path").agg(*counts).fillna(0, ["blocks"])
    segments = F.transform(F.slice(F.split("path", "/"), 2, 1 << 30), _form)
    now = keep(paths.withColumn("segments", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments)).withColumn("template", F.lit("")), "paths")
    done, turn = now.where(F.size("segments") == 0), 0
    now = now.where(F.size("segments") > 0)
    enough = max(1, math.ceil(round((2 * purity - 1) / (1 - purity), 9))) if purity < 1 else math.inf
    while not now.isEmpty():
        here = (_along_chains(now) if turn >= FEW_TURNS else now).withColumn("segment", F.get("segments", F.lit(0)))
        children = here.groupBy(F.col("host").alias("gh"), F.col("template").alias("gt"), F.col("segment").alias("gs")).agg(F.count(F.lit(1)).alias("paths"), F.sum("n").alias("urls"), F.sum("labels").alias("labels"))
        children = keep(children, "children")
        nodes = children.groupBy(F.col("gh").alias("nh"), F.col("gt").alias("nt")).agg(F.count(F.lit(1)).alias("kids"), F.sum("urls").alias("all_urls"))
        children = join_groups(children, nodes, (F.col("gh") == F.col("nh")) & (F.col("gt") == F.col("nt")))
        many = (F.col("kids") > most_children) | ((F.col("all_urls") >= 10) & (F.col("kids") >= MANY_SHARE * F.col("all_urls")))
        rare = (F.col("paths") < RARE) & ((F.col("labels") < enough) if enough < math.inf else F.lit(True))
        token = F.when(many & rare & (F.col("gs") != ""), "*").otherwise(F.col("gs"))
        children = keep(children.select("gh", "gt", "gs", F.concat("gt", F.lit("/"), token).alias("next"), "urls"), "tokens")
        sizes = children.groupBy(F.col("gh").alias("sh"), F.col("next").alias("sn")).agg(F.sum("urls").alias("size"))
        children = join_groups(children, sizes, (F.col("gh") == F.col("sh")) & (F.col("next") == F.col("sn"))).select("gh", "gt", "gs", "next", "size")
        moved = join_groups(here, children, (F.col("host") == F.col("gh")) & (F.col("template") == F.col("gt")) & (F.col("segment") == F.col("gs")))
        more = F.size("segments") > 1
        moved = moved.withColumn("open", more & (F.col("size") >= SPLIT)).withColumn("template", F.when(more & (F.col("size") < SPLIT), F.concat("next", F.lit("/**"))).otherwise(F.col("next")))
        moved = keep(moved.select("host", "path", "n", "labels", "blocks", F.expr("slice(segments, 2, size(segments))").alias("segments"), "template", "open"), "level")
        done = done.union(moved.where("not open").drop("open"))
        now, turn = moved.where("open").drop("open"), turn + 1
    return done.select("host", "path", "template", "n", "labels", "blocks")


def _rejected(purity: float) -> Column:
    return ((F.col("blocks") + 1) / (F.col("labels") + 2.0) >= purity) & (F.col("labels") >= SUPPORT * F.col("n"))


def merged(found: DataFrame) -> DataFrame:
    """(host, template, n, labels, blocks) of templates, each with the counts of the largest merged branch it is in."""
    own = keep(found.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("blocks").alias("blocks")), "templates")
    parts = F.split("template", "/")
    # The template with each of its own segments in turn left open.
    opened = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: ~F.get(parts, i).isin("", "*", "**")),
        lambda i: F.array_join(F.transform(parts, lambda x, j: F.when(j == i, F.lit("\x00")).otherwise(x)), "/"),
    )
    branches = keep(own.withColumn("branch", F.explode(opened)), "branches")
    outcomes = {"b": F.col("blocks"), "a": F.col("labels") - F.col("blocks"), "u": F.col("n") - F.col("labels")}
    sums = [F.sum(x).alias(k) for k, x in outcomes.items()] + [F.sum(x * x / F.col("n")).alias(f"s{k}") for k, x in outcomes.items()]
    groups = branches.groupBy(F.col("host").alias("gh"), F.col("branch").alias("gb")).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all_n"), F.sum("labels").alias("all_labels"), F.sum("blocks").alias("all_blocks"), *sums).where("members > 1")
    present = sum((F.col(k) > 0).cast("int") for k in outcomes)
    statistic = F.col("all_n") * (sum(F.when(F.col(k) > 0, F.col(f"s{k}") / F.col(k)).otherwise(0.0) for k in outcomes) - 1)
    free = ((F.col("members") - 1) * (present - 1)).cast("double")
    limit = free * F.pow(1 - 2 / (9 * free) + Z * F.sqrt(2 / (9 * free)), 3)  # Wilson and Hilferty's approximation
    alike = groups.where((free == 0) | (statistic <= limit)).select("gh", "gb", "all_n", "all_labels", "all_blocks")
    joined = join_groups(branches, alike, (F.col("host") == F.col("gh")) & (F.col("branch") == F.col("gb")))
    widest = joined.groupBy(F.col("host").alias("wh"), F.col("template").alias("wt")).agg(F.max(F.struct("all_n", "all_labels", "all_blocks", "branch")).alias("w"))
    wide = own.join(widest, (F.col("host") == F.col("wh")) & (F.col("template") == F.col("wt")), "left")
    return wide.select("host", "template", F.coalesce("w.all_n", "n").alias("n"), F.coalesce("w.all_labels", "labels").alias("labels"), F.coalesce("w.all_blocks", "blocks").alias("blocks"))


def verdicts(urls: DataFrame, purity: float = PURITY, most_children: int = MOST_CHILDREN) -> DataFrame:
    """(host, path, rejected) of each distinct path of ``urls(host, path, label)``."""
    found = keep(templates(urls, purity, most_children), "found")
    of_template = merged(found).select(F.col("host").alias("th"), F.col("template").alias("tt"), _rejected(purity).alias("rejected"))
    return join_groups(found, of_template, (F.col("host") == F.col("th")) & (F.col("template") == F.col("tt"))).select("host", "path", "rejected")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, purity: float = PURITY, most_children: int = MOST_CHILDREN) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages(page_id, url)``.

    A null url, or one without ://, has an empty host and path. Repeated rows are each returned, and count as
    urls each. Other columns are not looked at. Of equally long rules the first in order is taken.
    """
    urls = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), verdict.alias("label"))
    judged = keep(verdicts(urls.select("host", "path", "label"), purity, most_children), "verdicts")
    judged = judged.withColumnsRenamed({"host": "jh", "path": "jp"})
    joined = urls.join(judged, (F.col("host") == F.col("jh")) & (F.col("path") == F.col("jp")))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"))


#: The same result in another engine's SQL, by windows over one recursive table of levels; for the rules and parameters above.
SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM u),
l AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS label FROM r),
d AS (SELECT host, path, count(*)::BIGINT AS n, count(label)::BIGINT AS labels, count(*) FILTER (WHERE label = 'block')::BIGINT AS blocks,
  list_transform(string_split(path, '/')[2:], lambda x: CASE WHEN length(x) >= 16 AND regexp_full_match(x, '[0-9a-fA-F]+') THEN 'f' ELSE regexp_replace(regexp_replace(x, '^[0-9]+', '9'), '^([*=])', '=\1') END) AS segs FROM l GROUP BY host, path),
lv AS (
  SELECT host, path, n, labels, blocks, segs, 0 AS k, '' AS template, path <> '' AS is_open FROM d
  UNION ALL
  SELECT host, path, n, labels, blocks, segs, k + 1, template || '/' || token || CASE WHEN len(segs) > k + 1 AND size < 10 THEN '/**' ELSE '' END, len(segs) > k + 1 AND size >= 10
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, template, token) AS size FROM (
    SELECT *, CASE WHEN seg <> '' AND (kids > 50 OR (all_urls >= 10 AND kids >= 0.9 * all_urls)) AND paths < 10 AND child_labels < 3 THEN '*' ELSE seg END AS token FROM (
      SELECT *, count(DISTINCT seg) OVER (PARTITION BY host, template) AS kids, sum(n) OVER (PARTITION BY host, template) AS all_urls, count(*) OVER (PARTITION BY host, template, seg) AS paths,
        sum(labels) OVER (PARTITION BY host, template, seg) AS child_labels FROM (SELECT *, segs[k + 1] AS seg FROM lv WHERE is_open))))),
t AS (SELECT * FROM lv WHERE NOT is_open),
own AS (SELECT host, template, sum(n)::DOUBLE AS n, sum(labels)::DOUBLE AS labels, sum(blocks)::DOUBLE AS blocks FROM t GROUP BY host, template),
open_at AS (SELECT *, string_split(template, '/') AS parts, unnest(range(1, len(string_split(template, '/')) + 1)) AS i FROM own),
br AS (SELECT host, template, n, labels, blocks, list_transform(parts, lambda x, j: CASE WHEN j = i THEN NULL ELSE x END) AS branch FROM open_at WHERE parts[i] NOT IN ('', '*', '**')),
gr AS (SELECT host, branch, count(*) AS m, sum(n) AS n, sum(labels) AS labels, sum(blocks) AS blocks,
  sum(n) * (coalesce(sum(blocks * blocks / n) / nullif(sum(blocks), 0), 0) + coalesce(sum((labels - blocks) ** 2 / n) / nullif(sum(labels - blocks), 0), 0) + coalesce(sum((n - labels) ** 2 / n) / nullif(sum(n - labels), 0), 0) - 1) AS stat,
  (count(*) - 1) * ((sum(blocks) > 0)::INT + (sum(labels - blocks) > 0)::INT + (sum(n - labels) > 0)::INT - 1) AS df FROM br GROUP BY host, branch HAVING count(*) > 1),
ok AS (SELECT * FROM gr WHERE df = 0 OR stat <= df * (1 - 2.0 / (9 * df) + 1.645 * sqrt(2.0 / (9 * df))) ** 3),
w AS (SELECT br.host, br.template, max({'n': ok.n, 'labels': ok.labels, 'blocks': ok.blocks}) AS w FROM br JOIN ok ON br.host = ok.host AND br.branch = ok.branch GROUP BY 1, 2),
f AS (SELECT own.host, own.template, coalesce(w.w.n, n) AS n, coalesce(w.w.labels, labels) AS labels, coalesce(w.w.blocks, blocks) AS blocks FROM own LEFT JOIN w ON own.host = w.host AND own.template = w.template)
SELECT page_id, l.host, l.path, rule, coalesce(label, CASE WHEN (f.blocks + 1) / (f.labels + 2) >= 0.8 AND f.labels >= 0.1 * f.n THEN 'block' ELSE 'allow' END) AS verdict
FROM l JOIN t ON l.host = t.host AND l.path = t.path JOIN f ON t.host = f.host AND t.template = f.template
"""
