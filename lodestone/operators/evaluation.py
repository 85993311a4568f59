"""Evaluation, reports, corpus catalogue and stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V


def latency(rows: DataFrame, group: str, value: str, cells: int = 256) -> DataFrame:
    """(group, p50, p95, mean): the median, the value at place floor(0.95 (n - 1)) and the mean; nulls don't count.

    Approximate quantiles of each group cut its values into ``cells`` of about as many rows each, whatever their
    distribution; counts say in which cell each place lies, and only the distinct values of those cells are then put in
    order, so a group that holds most rows is no single task's sort.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    cuts = F.percentile_approx("v", [i / cells for i in range(1, cells)])
    whole = own.groupBy("g").agg(F.count("*").alias("all"), cuts.alias("cuts"), F.avg("v").alias("mean"))
    place = F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2), F.floor(0.95 * (F.col("all") - 1)))
    cell = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    counted = own.groupBy("g", "v").agg(F.count("*").alias("n")).join(whole.select("g", "all", "cuts"), "g").select("g", "all", "v", "n", cell.alias("cell"))
    upto = Window.partitionBy("g").orderBy("cell")
    line = counted.groupBy("g", "all", "cell").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(upto) - F.col("n"))
    asked = line.select("g", "cell", "before", "n", F.posexplode(place).alias("which", "place")).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    near = counted.select("g", "cell", "v", F.col("n").alias("times")).join(asked.drop("n"), ["g", "cell"])
    rank = F.sum("times").over(Window.partitionBy("g", "which").orderBy("v")) + F.col("before")
    found = near.withColumn("upto", rank).where(F.col("upto") > F.col("place")).groupBy("g", "which").agg(F.min("v").alias("v"))
    at = lambda i: F.max(F.when(F.col("which") == i, F.col("v")))
    out = found.groupBy("g").agg(((at(0) + at(1)) / 2).alias("p50"), at(2).alias("p95")).join(whole.select("g", "mean"), "g")
    return out.select(F.col("g").alias(group), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("mean", 6).alias("mean"))


def answer_eval(answers: DataFrame, group: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    faith = F.least(F.lit(1.0), F.avg(words) / 200)
    return answers.groupBy(group).agg(F.round(faith, 6).alias("faithfulness"), F.round(1 - faith, 6).alias("unsupported_rate"), F.count("*").alias("n"))


def validation_summary(rows: DataFrame) -> DataFrame:
    """(task_type, total, passed, rate) with a line ``all``."""
    out = rows.rollup("task_type").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return out.select(F.coalesce("task_type", F.lit("all")).alias("task_type"), "total", "passed", F.round(F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0), 6).alias("rate"))


def failure_breakdown(rows: DataFrame) -> DataFrame:
    """(dimension, value, failures) of rows that failed, over task type, document and status at once."""
    failed = rows.where("not passed").select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in ("task_type", "slug", "status", *(["check"] if "check" in rows.columns else []))))).alias("x"))
    return failed.groupBy("x.dimension", "x.value").agg(F.count("*").alias("failures"))


def compare(base: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change) of rows in both reports: fixed, regressed or still failing; of repeated keys the last counts."""
    last = lambda r, n: r.groupBy("key").agg(F.max_by("passed", "pos").alias(n))
    both = last(base, "a").join(last(new, "b"), "key")
    return both.select("key", F.when(~F.col("a") & F.col("b"), "fixed").when(F.col("a") & ~F.col("b"), "regressed").when(~F.col("b"), "unchanged_fail").alias("change")).where("change is not null")


def tag_counts(rows: DataFrame, tags: str, every: list[str]) -> DataFrame:
    """(tag, n) over multi-valued tags, zero-filled."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(t,) for t in every], "tag string")
    own = rows.select(F.explode(F.array_distinct(F.col(tags))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(own, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def corpus_status(manifest: DataFrame, indexed: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, file_present, n_indexed, action): what a sync would do with each document of the manifest."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    have = indexed.select(name(F.col("source_path")).alias("filename"), "doc_id").groupBy("filename").agg(F.count_distinct("doc_id").alias("n"))
    disk = files.select(name(F.col("path")).alias("filename"), F.lit(True).alias("there")).distinct()
    out = manifest.select("slug", name(F.col("filename")).alias("filename")).join(have, "filename", "left").join(disk, "filename", "left")
    there, n = F.coalesce("there", F.lit(False)), F.coalesce("n", F.lit(0)).cast("long")
    return out.select("slug", there.alias("file_present"), n.alias("n_indexed"), F.when(n > 0, "skip").when(there, "ingest").otherwise("download").alias("action"))


def auto_checks(task: Column, expected: Column, inferred: Column, final: Column, status: Column, metrics: Column, claims: Column, unsupported: Column, limits: Column, conflicts: Column, least_metrics: Column) -> Column:
    """The checks of a task type and whether all pass, as a map."""
    common = {"target_doc_inferred": F.arrays_overlap(expected, inferred), "final_doc_overlap": F.arrays_overlap(expected, final)}
    own = (
        F.when(task == "scoped_document_query", F.create_map(F.lit("non_off_target_audit"), status != "off_target_evidence"))
        .when(task == "metric_extraction_query", F.create_map(F.lit("metric_minimum_met"), metrics >= least_metrics))
        .when(task == "supported_claim_query", F.create_map(F.lit("supported_claims_present"), claims > 0, F.lit("non_insufficient_audit"), status != "insufficient_evidence"))
        .when(task == "unsupported_topic_query", F.create_map(F.lit("unsupported_surfaced"), (unsupported > 0) | (status == "insufficient_evidence")))
        .otherwise(F.create_map(F.lit("limitation_or_conflict"), (limits > 0) | (conflicts > 0)))
    )
    return F.map_concat(F.create_map(*(x for k, v in common.items() for x in (F.lit(k), F.coalesce(v, F.lit(False))))), own)


def incomplete(tasks: DataFrame, every: list[str]) -> DataFrame:
    """(slug, missing): task types that a paper of the matrix lacks."""
    have = tasks.groupBy("slug").agg(F.collect_set("task_type").alias("t"))
    return have.select("slug", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, every)), F.col("t"))), ",").alias("missing")).where("missing <> ''")


def draft_items(papers: DataFrame, existing: DataFrame, tasks: list[str]) -> DataFrame:
    """(id, slug, task_type) of drafts that don't exist yet."""
    drafts = papers.select("slug", F.explode(F.array(*map(F.lit, tasks))).alias("task_type")).select(F.concat_ws("-", X.slug(F.col("slug")), X.slug(F.col("task_type"))).alias("id"), "slug", "task_type")
    return drafts.join(existing.select("id"), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, created: str, updated: str) -> DataFrame:
    """Rows of both by key: the newest version with the oldest time of creation."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (key, created)]
    out = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(updated)).alias("r"), F.min(created).alias(created))
    return out.select(key, created, "r.*")


def recent(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The last k rows of each group; ranks are limited before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def lru(accesses: DataFrame, key: str, at: str, capacity: int) -> DataFrame:
    """(key, last_used, hits) of the keys that a cache of the capacity would hold at the end."""
    used = accesses.groupBy(key).agg(F.max(at).alias("last_used"), F.count("*").alias("hits"))
    return used.orderBy(F.col("last_used").desc(), key).limit(capacity)


def abbreviations(tokens: DataFrame, least: int = 2) -> DataFrame:
    """(token, frequency, docs, dominant, confidence): how often and how evenly a short token is used."""
    per = tokens.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    out = per.groupBy("token").agg(F.sum("n").alias("frequency"), F.count("*").alias("docs"), F.max("n").alias("most")).where(F.col("frequency") >= least)
    dominant = F.col("most") / F.col("frequency")
    return out.select("token", "frequency", "docs", F.round(dominant, 6).alias("dominant"), F.round(F.least(F.lit(1.0), 0.3 + 0.5 * dominant + 0.02 * F.least(F.col("frequency"), F.lit(25))), 3).alias("confidence"))


def abbreviation_details(passages: DataFrame, least: int = 2, top: int = 10, contexts: int = 5) -> DataFrame:
    """One row a short token: frequency, its ``top`` documents with counts, counts by mode, the first ``contexts`` passages, confidence and whether it should be reviewed.

    ``passages``: (doc_id, chunk_id, mode, context, short_tokens). Counts are summed before they are ranked, and ranks are
    limited before the shuffle, so a token that a third of all passages holds brings no more rows to its task than others.
    """
    each = passages.select("doc_id", "chunk_id", "mode", F.left(X.strip(F.coalesce("context", F.lit(""))), F.lit(200)).alias("context"), F.posexplode("short_tokens").alias("pos", "token"))
    modes = each.groupBy("token", "mode").agg(F.count("*").alias("n")).groupBy("token")
    modes = modes.agg(F.sum("n").alias("frequency"), F.max("n").alias("most"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("modes"))
    nth = lambda *order: F.row_number().over(Window.partitionBy("token").orderBy(*order))
    docs = each.groupBy("token", "doc_id").agg(F.count("*").alias("n")).withColumn("rank", nth(F.col("n").desc(), "doc_id")).where(F.col("rank") <= top)
    docs = docs.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "n"))).alias("x")).select("token", F.transform("x", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["n"].alias("n"))).alias("documents"))
    first = each.withColumn("rank", nth("doc_id", "chunk_id", "pos")).where(F.col("rank") <= contexts)
    first = first.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "chunk_id", "context"))).alias("x")).select("token", F.transform("x", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["chunk_id"].alias("chunk_id"), x["context"].alias("context"))).alias("contexts"))
    confidence = F.round(F.least(F.lit(1.0), 0.3 + 0.5 * F.col("most") / F.col("frequency") + 0.02 * F.least(F.col("frequency"), F.lit(25))), 3)
    review = ~F.col("token").isin(*V.SHORT_TOKENS) & (F.col("frequency") >= 3)
    own = modes.where(F.col("frequency") >= least).join(docs, "token").join(first, "token")
    return own.select("token", "frequency", "documents", "modes", "contexts", X.long_form(F.col("token")).alias("long_form"), confidence.alias("confidence"), review.alias("review"))
