"""URL filtering by path-template trees, in DataFrame functions.

Rules decide where one fits; the URLs they decide are also the labels from which templates learn about the rest.
A path becomes a list of segments whose digit runs are wildcards; below ``depth`` the rest of the path, whole, is the
last one, so a path of thousands of segments costs no more levels and no two paths are mixed up. Per host, level by level, a segment that many siblings share the traffic with (more than ``siblings`` of them, each
below ``least`` of the parent's URLs) becomes a wildcard too, and the remaining branches are put in the order of
their smoothed share of blocked URLs and merged with their neighbour unless the two shares differ beyond chance.
A template (host and list of branches) is rejected if its smoothed share of blocked labels is above one half; it
is smoothed towards the same path's share over all hosts, and that towards the share of all labels.

Rows are counted by host and segment before anything else moves, so a host that holds a third of all rows
costs a few rows of counts. The table of templates is broadcast when its counted size is within bounds.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged like any
other template; URLs without any label are allowed unless what is known says otherwise; repeated rows each get their
row; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored
from lodestone.llm.decontam import small

DEPTH, SIBLINGS, LEAST = 6, 20, 0.05
#: Strength of the smoothing, in URLs; the normal quantile beyond which two shares differ.
WEIGHT, CHANCE = 8.0, 1.96
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    text = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, 1)
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, 2)


def rule_of(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits a host or its subdomain and begins the path; nulls if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, _, start = r.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segments(path: str, depth: int = DEPTH) -> Column:
    """The path's first segments and the rest of it as one, with digit runs as wildcards."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.col(path), "^/", ""), "[0-9]+", "*"), "/", depth + 1)
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.concat(F.lit("**/"), F.element_at(parts, -1))))).otherwise(parts)


def templates(counts: DataFrame, depth: int, siblings: int = SIBLINGS, least: float = LEAST, weight: float = WEIGHT) -> DataFrame:
    """Adds ``template`` to (host, segs, n, allowed, blocked) rows: the branch of each level."""
    rows = counts.withColumn("template", F.array().cast("array<string>"))
    rate = (F.col("blocked") + weight / 2) / (F.col("allowed") + F.col("blocked") + weight)
    for level in range(depth):
        here = rows.where(F.size("segs") > level).withColumn("seg", F.col("segs")[level])
        sums = [F.sum(c).alias(c) for c in ("n", "allowed", "blocked")]
        child = stored(here.groupBy("host", "template", "seg").agg(*sums), "branches")
        parent = child.groupBy("host", "template").agg(F.count("*").alias("branches"), F.sum("n").alias("all"))
        named = child.join(parent, ["host", "template"])
        rest = F.col("seg").startswith("**/")
        wide = (F.col("branches") > siblings) & (F.col("n") < least * F.col("all"))
        named = named.withColumn("kept", F.when(wide, F.when(rest, "**").otherwise("*")).otherwise(F.col("seg")))
        kept = named.groupBy("host", "template", "kept").agg(*sums).withColumn("labelled", F.col("allowed") + F.col("blocked")).withColumn("rate", rate)
        # At most ``siblings`` or 1 / least named branches and a wildcard are left below a parent.
        order = Window.partitionBy("host", "template", F.col("labelled") > 0).orderBy("rate", "kept")
        spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("labelled") + weight) + F.lag("rate").over(order) * (1 - F.lag("rate").over(order)) / (F.lag("labelled").over(order) + weight))
        apart = (F.lag("rate").over(order).isNull() | (F.col("labelled") == 0) | ((F.col("rate") - F.lag("rate").over(order)) > CHANCE * spread)).cast("int")
        grouped = kept.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        names = grouped.groupBy("host", "template", F.col("labelled") > 0, "group").agg(F.array_sort(F.collect_list("kept")).alias("members"))
        branch = names.select("host", "template", F.explode("members").alias("kept"), F.array_join("members", "|").alias("branch"))
        step = named.select("host", "template", "seg", "kept").join(branch, ["host", "template", "kept"]).select("host", "template", "seg", "branch")
        grown = here.join(step, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.array("branch")))
        rows = stored(grown.select(*rows.columns).unionByName(rows.where(F.size("segs") <= level)), "templates")
    return rows


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", depth: int = DEPTH, weight: float = WEIGHT) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity): purity is the smoothed share of allowed labels of the row's template."""
    parsed = pages.select(F.col(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rule, said = rule_of(rules)
    parsed = parsed.withColumn("rule", rule).withColumn("said", said).withColumn("segs", segments("path", depth))
    counts = parsed.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"))
    counts = stored(counts, "paths")
    deepest = counts.agg(F.max(F.size("segs"))).first()[0] or 0
    named = templates(counts, deepest)
    total = named.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).select(((F.coalesce("b", F.lit(0)) + 1) / (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) + 2)).alias("overall"))
    shape = named.groupBy("segs").agg(F.sum("allowed").alias("sa"), F.sum("blocked").alias("sb")).crossJoin(F.broadcast(total))  # one row
    shape = shape.select("segs", ((F.col("sb") + weight * F.col("overall")) / (F.col("sa") + F.col("sb") + weight)).alias("alike"))
    leaf = named.groupBy("host", "template").agg(F.sum("allowed").alias("la"), F.sum("blocked").alias("lb"))
    share = (F.col("lb") + weight * F.col("alike")) / (F.col("la") + F.col("lb") + weight)
    judged = named.select("host", "segs", "template").join(leaf, ["host", "template"]).join(shape, "segs").select("host", "segs", "template", share.alias("share"))
    out = parsed.join(small(stored(judged, "judged")), ["host", "segs"], "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("said", F.when(F.col("share") > 0.5, "block").otherwise("allow")).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), (1 - F.col("share")).alias("purity"))
