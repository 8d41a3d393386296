"""URL filter by path templates: a tree per host, wildcards, merged branches, smoothed purity.

Every path is a walk through its host's tree. Level by level a segment stays
itself only if enough pages pass through it and its labels differ from those of
its siblings; else the branch is merged into the wildcard of its parent. What
is left is a template such as ``/en/*``. A template's share of bad labels is
smoothed towards its host's share, and that towards the share of all labels;
a page is blocked when its template's smoothed share reaches the threshold.

Only built-in functions are used. Statistics are taken from distinct paths, so
repeated urls meet before the first shuffle, and the segments that stay (few,
by their support) are what is joined back, never pages with pages.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest of the ``(verdict, host, path)`` rules that fits, as a struct; NULL when none does.

    A rule fits its host and all subdomains when the path starts with its own.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def levels(paths: DataFrame, support: int) -> int:
    """The deepest level that a branch with enough pages can reach: below it no host has that many pages."""
    size = F.size(F.split(F.regexp_replace("path", "^/", ""), "/"))
    sizes = paths.groupBy("host", size.alias("k")).agg(F.sum("pages").alias("pages"))
    through = F.sum("pages").over(Window.partitionBy("host").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("through", through).filter(F.col("through") >= support).agg(F.max("k")).first()[0] or 0


def templates(paths: DataFrame, support: int = 20, z: float = 2.0) -> DataFrame:
    """``paths`` (``host, path, pages, good, bad``) with the ``template`` of each.

    A segment with digits only, or with fewer than ``support`` pages, or whose
    share of bad labels is within ``z`` standard errors of its siblings', goes
    into the wildcard. The tree is as deep as there are branches with enough
    pages; below, every segment is a wildcard.
    """
    depth = levels(paths, support)
    rows = paths.withColumns({"_segs": F.split(F.regexp_replace("path", "^/", ""), "/"), "template": F.lit("")})
    for level in range(1, depth + 1):
        rows = rows.withColumn("_seg", F.try_element_at("_segs", F.lit(level)))
        there = F.col("_seg").isNotNull()
        branch = rows.filter(there & ~F.col("_seg").rlike("^[0-9]*$")).groupBy("host", "template", "_seg").agg(*[F.sum(c).alias(c) for c in ("pages", "good", "bad")])
        under = rows.filter(there).groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        branch = branch.filter(F.col("pages") >= support).join(under, ["host", "template"])
        n, rest = F.col("good") + F.col("bad"), F.col("g") + F.col("b") - F.col("good") - F.col("bad")
        pooled = (F.col("b") + 1) / (F.col("g") + F.col("b") + 2)
        gap = F.abs((F.col("bad") + 1) / (n + 2) - (F.col("b") - F.col("bad") + 1) / (rest + 2))
        error = F.sqrt(pooled * (1 - pooled) * (1 / (n + 2) + 1 / (rest + 2)))
        # A branch without siblings has none to differ from; it stays, as part of the host's fixed beginning.
        stays = branch.filter((gap > z * error) | (rest == 0)).select("host", "template", "_seg", F.lit(True).alias("_stays"))
        rows = rows.join(stays, ["host", "template", "_seg"], "left")
        part = F.when(~there, F.lit("")).when(F.coalesce("_stays", F.lit(False)), F.concat(F.lit("/"), "_seg")).otherwise(F.lit("/*"))
        rows = rows.withColumn("template", F.concat("template", part)).drop("_stays", "_seg")
        if level % 4 == 0:
            rows = cut_lineage(rows)
    deeper = F.repeat(F.lit("/*"), F.greatest(F.size("_segs") - depth, F.lit(0)))
    return rows.withColumn("template", F.concat("template", deeper)).drop("_segs")


def judged(pages: DataFrame, rules, url: str = "url", label: str | None = None, support: int = 20, z: float = 2.0,
           weight: float = 10.0, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host, path, rule, template, bad_share, verdict``.

    ``label`` names a column with 1 for bad and 0 for good pages; without one
    the pages that a rule decides are the labelled examples. Where a rule fits
    its verdict holds, else the template's. Urls that are NULL, empty or
    without ``://`` share the empty host and path and are judged by its
    template like all others. Without any label nothing is blocked. Columns of
    ``pages`` with the names above are replaced.
    """
    own = ["host", "path", "rule", "template", "bad_share", "verdict"]
    rows = pages.drop(*own) if url not in own else pages
    rows = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    bad = F.col(label).cast("int") if label else F.when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule.verdict") == "allow", 0)
    paths = cut_lineage(rows.select("host", "path", bad.alias("_bad")).groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.count_if(F.col("_bad") == 0).alias("good"), F.count_if(F.col("_bad") == 1).alias("bad")))
    known = cut_lineage(templates(paths, support, z).select("host", "path", "template", "good", "bad"))
    hosts = _host_shares(known, weight)
    per = known.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).join(hosts, "host")
    per = per.select("host", "template", ((F.col("b") + weight * F.col("host_share")) / (F.col("g") + F.col("b") + weight)).alias("bad_share"))
    known = known.select("host", "path", "template").join(per, ["host", "template"])
    out = rows.join(known, ["host", "path"], "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_share") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumns({"rule": F.col("_rule.rule"), "verdict": verdict}).drop("_rule")


def _host_shares(known: DataFrame, weight: float) -> DataFrame:
    """Each host's share of bad labels, smoothed towards the share of all labels (none: 0), which is read as a scalar."""
    base = F.coalesce(known.agg(F.try_divide(F.sum("bad"), F.sum("good") + F.sum("bad")).alias("base")).scalar(), F.lit(0.0))
    return known.groupBy("host").agg(((F.sum("bad") + weight * base) / (F.sum("good") + F.sum("bad") + weight)).alias("host_share"))
