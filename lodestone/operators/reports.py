"""Scoped seeds, claims and their rendering, variant coverage, probe integrity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import text as X
from lodestone.operators import evaluation as E


def _low() -> Column:
    return F.lower(F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))


def target_seed(overlap: Column, info: Column, noise: Column, figure: Column, has_metrics: Column, suits: Column) -> Column:
    """Score of a passage of a named document, null where it is rejected."""
    bad = (overlap < 0.2) | (noise > 0.5) | (figure & ~has_metrics & (info < 0.6))
    return F.when(~bad, 0.7 * overlap + 0.3 * info + F.when(has_metrics, 0.03).otherwise(0.0) - F.when(suits, 0.0).otherwise(0.12) - F.least(F.lit(0.2), noise * 0.2))


def label_overlap(terms: Column, labels: Column) -> Column:
    """Share of the query's metric terms that a label or task of a meaningful record holds."""
    from lodestone.functions import values as V

    asked = F.array_intersect(F.transform(terms, X.key), F.array(*map(F.lit, V.METRIC_QUERY_TERMS)))
    names = F.filter(F.transform(labels, X.key), lambda x: x != "")
    return F.when((F.size(asked) > 0) & (F.size(names) > 0), F.size(F.filter(asked, lambda t: F.exists(names, lambda n: F.contains(n, t)))) / F.size(asked)).otherwise(0.0)


def metric_seed(overlap: Column, info: Column, noise: Column, boilerplate: Column, n_metrics: Column, signal: Column, labels: Column, chunk_type: Column, suits: Column) -> Column:
    """Score of a passage of a named document that reports metrics, null where it is rejected."""
    bad = (F.greatest(overlap, info) < 0.1) | (noise > 0.5) | boilerplate | ((n_metrics == 0) & ~signal) | ((overlap < 0.1) & (labels < 0.2))
    strength = F.when(n_metrics > 0, F.least(F.lit(1.0), n_metrics / 3)).otherwise(0.7)
    bonus = F.when(chunk_type.isin("body", "table"), 0.05).when(chunk_type.isin("caption", "figure_derived"), 0.02).otherwise(0.0)
    return F.when(~bad, 0.42 * overlap + 0.22 * info + 0.24 * strength + 0.12 * labels + bonus - F.least(F.lit(0.2), noise * 0.2) - F.when(suits, 0.0).otherwise(0.1))


def target_seeds(c: DataFrame, mode: str = "paper", most: int = 2) -> DataFrame:
    """The best passage of each target document of a query, two at most, where no other run found a target.

    ``c``: query_id, terms, found_target, doc_id, chunk_id, text, summary, chunk_type, doc_type, is_table_or_figure, noise_level, has_metrics; rows of target documents only.
    """
    info = X.informative(F.col("terms"), mode)
    figure = C.is_figure_chunk(F.col("chunk_type"), F.col("is_table_or_figure"))
    noise = C.effective_noise(F.col("text"), F.col("chunk_type"), F.col("is_table_or_figure"), F.col("noise_level"))
    over = X.overlap(F.col("terms"), _low())
    own = F.when(F.size(info) > 0, X.overlap(info, _low())).otherwise(over)
    scored = c.where(~F.col("found_target")).withColumn("score", F.round(target_seed(over, own, noise, figure, F.col("has_metrics"), C.mode_context(F.col("doc_type"), mode)), 6)).where("score is not null")
    best = E.recent(scored.withColumn("own", F.concat_ws(":", "query_id", "doc_id")), "own", [F.col("score").desc(), F.col("chunk_id")], 1).drop("rank", "own")
    return E.recent(best, "query_id", [F.col("score").desc(), F.col("doc_id")], most)


def seed_candidates(docs: DataFrame, queries: DataFrame, mode: str = "paper", most: int = 2) -> DataFrame:
    """(query_id, terms, doc_id, text) of each pair that ``target_seeds`` could keep, from all documents and all queries.

    A term lies in a text if it lies in one of the text's tokens, so each task looks its distinct tokens up once and
    scores every query of each document by a matrix product. It gives its best documents of a query and those within
    the rounding of them. The queries are held by the driver.
    """
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms"), F.array_distinct(X.informative(F.col("terms"), mode)).alias("info")).collect()
    names = {t: i for i, t in enumerate(sorted({t for r in asked for t in r.terms}))}
    lengths = sorted({len(t) for t in names})
    table = {k: np.zeros((len(names), len(asked)), np.float32) for k in ("terms", "info")}
    for j, r in enumerate(asked):
        for k, x in table.items():
            x[[names[t] for t in r[k]], j] = 1
    sizes = {k: np.array([len(r[k]) for r in asked], np.float64) for k in table}
    slack = 2e-6

    def held(word: str) -> tuple:
        return tuple({names[t] for n in lengths for i in range(len(word) - n + 1) if (t := word[i : i + n]) in names})

    def share(hits, k: str, none):
        return np.where(sizes[k] > 0, hits / np.maximum(sizes[k], 1), none)

    def leading(rows: dict) -> dict:
        """The rows that can be among the best: of equal scores, those of the smallest ids."""
        best = sorted(rows.items(), key=lambda x: (-x[1][0], x[0] is not None, x[0]))
        least, times, out = best[min(most, len(best)) - 1][1][0] - slack, {}, {}
        for doc, (score, text) in best:
            times[score] = times.get(score, 0) + 1
            if score >= least and times[score] <= most:
                out[doc] = (score, text)
        return out

    def score(batches):
        known: dict[str, tuple] = {}
        kept: list[dict] = [{} for _ in asked]
        least = np.full(len(asked), -np.inf)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                ids, found = batch.column(0).to_pylist(), np.zeros((len(batch), len(names)), np.float32)
                for i, words in enumerate(batch.column(2).to_pylist()):
                    own: set = set()
                    for w in words or ():
                        if (x := known.get(w)) is None:
                            if len(known) > 500_000:
                                known.clear()
                            x = known[w] = held(w)
                        own.update(x)
                    found[i, list(own)] = 1
                over = share(found @ table["terms"], "terms", 1.0)
                total = np.where(over < 0.2, -np.inf, 0.7 * over + 0.3 * share(found @ table["info"], "info", over))
                good = (total > -np.inf) & (total >= least - slack)
                for j in np.flatnonzero(good.any(0)).tolist():
                    for i in np.flatnonzero(good[:, j]).tolist():
                        if ids[i] not in kept[j] or kept[j][ids[i]][0] < total[i, j]:
                            kept[j][ids[i]] = (float(total[i, j]), batch.column(1)[i].as_py())
                    kept[j] = leading(kept[j])
                    if len(kept[j]) >= most:
                        least[j] = sorted((x[0] for x in kept[j].values()), reverse=True)[most - 1]
        for j, rows in enumerate(kept):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(rows), pa.int32()), pa.array(list(rows), kind), pa.array([x[1] for x in rows.values()], pa.string()), pa.array([x[0] for x in rows.values()])], names=["slot", "doc_id", "text", "near"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    words = F.array_distinct(X.tokenize(F.col("text")))
    pairs = docs.select("doc_id", "text", words.alias("words")).mapInArrow(score, f"slot int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, near double")
    # Scores are taken again by the operator, which is slow on texts: only the leading pairs of all tasks go there.
    pairs = pairs.groupBy("slot", "doc_id").agg(F.max_by("text", "near").alias("text"), F.max("near").alias("near"))
    order = Window.partitionBy("slot").orderBy(F.col("near").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = pairs.withColumn("least", F.nth_value("near", most).over(order)).where(F.col("least").isNull() | (F.col("near") >= F.col("least") - slack))
    slots = docs.sparkSession.createDataFrame([(j, r.query_id, r.terms) for j, r in enumerate(asked)], f"slot int, query_id {queries.schema['query_id'].dataType.simpleString()}, terms array<string>")
    return pairs.join(slots, "slot").select("query_id", "terms", "doc_id", "text")


def claims(kept: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, pos, statement, strength, quality, doc_id, chunk_id): the first passages as claims, those of targets first."""
    own = kept.withColumn("statement", X.strip(F.coalesce(F.nullif("summary", F.lit("")), F.left("text", F.lit(280))))).where(F.col("statement") != "")
    best = E.recent(own, "query_id", [F.col("is_target").desc(), F.col("rank").asc()] if "is_target" in kept.columns else [F.col("rank").asc()], most)
    return best.select("query_id", F.col("rank").alias("pos"), "statement", F.lit("passage_summary").alias("strength"), F.lit("medium").alias("quality"), "doc_id", "chunk_id")


def render(claims_: DataFrame, coverage: DataFrame, status: DataFrame) -> DataFrame:
    """(query_id, page): claims with citations, missing topics, coverage and status as text."""
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), "statement", F.lit("\n   - citation: "), F.col("doc_id").cast("string"), F.lit(" chunk "), F.col("chunk_id").cast("string"))
    body = claims_.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("c"))
    text = F.coalesce(F.array_join(F.transform("c", lambda x: x["line"]), "\n"), F.lit("No supported claims; see unsupported topics below."))
    missing = F.when(F.col("missing_terms") != "", F.concat(F.lit("\n\n## Unsupported topics\n- "), F.replace("missing_terms", F.lit(","), F.lit("\n- ")))).otherwise("")
    foot = F.concat(F.lit("\n\nCoverage: "), F.col("total_passages").cast("string"), F.lit(" passages | "), F.col("metric_candidates").cast("string"), F.lit(" metrics | render status: "), "status")
    return coverage.join(body, "query_id", "left").join(status, "query_id").select("query_id", F.concat(F.lit("## Supported claims\n"), text, missing, foot).alias("page"))


def variant_coverage(v: DataFrame) -> DataFrame:
    """(query_id, counts, missing_fields) over the variant fields of a query's passages."""
    known = lambda *cs: F.count_if(X._any([F.col(c) != "Unknown" for c in cs]))
    out = v.groupBy("query_id").agg(
        F.count("*").alias("total_passages"), known("variant_id", "hgvs").alias("variants"), known("ancestry").alias("ancestry_mentions"), known("phenotype").alias("phenotype_mentions"),
        known("clinvar").alias("classes"), F.count("case_count").alias("cases"), F.count("control_count").alias("controls"), known("gnomad").alias("frequencies"),
    )
    names = {"variants": "variant identifier", "ancestry_mentions": "ancestry context", "classes": "ClinVar classification", "cases": "case counts", "controls": "control counts", "frequencies": "population frequency"}
    missing = F.array_compact(F.array(*(F.when(F.col(c) == 0, F.lit(n)) for c, n in names.items())))
    return out.select("query_id", "total_passages", "variants", "ancestry_mentions", "phenotype_mentions", F.array_join(missing, ", ").alias("missing_fields"))


def probe_integrity(rows: DataFrame) -> DataFrame:
    """(slug, queries, inferred, overlapping, blocked, reasons) of each probed document."""
    reasons = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))), ";")
    return rows.groupBy("slug").agg(F.count("*").alias("queries"), F.count_if("inferred").alias("inferred"), F.count_if("overlapping").alias("overlapping"), F.bool_or("blocked").alias("blocked"), reasons.alias("reasons"))


def probe_failures(rows: DataFrame) -> DataFrame:
    """(failure, n) over the five classes of probe failures; a row may fall in several."""
    this = F.contains(F.lower("query"), F.lit("this "))
    classes = {
        "target_inference_failure": ~F.col("inferred"),
        "doc_type_mode_mismatch": F.exists("reasons", lambda r: r.rlike("^(paper_primary_not_indexed_as_paper|expected_doc_type_mismatch)")),
        "retrieval_filtering_failure": F.col("inferred") & ~F.col("overlapping"),
        "query_phrasing_issue": this & ~F.col("inferred"),
        "genuine_evidence_absence": (F.col("status") == "insufficient_evidence") & F.col("overlapping"),
    }
    counts = rows.agg(*(F.count_if(c).alias(k) for k, c in classes.items()))
    return counts.select(F.explode(F.create_map(*(x for k in classes for x in (F.lit(k), F.col(k))))).alias("failure", "n"))


def report_summary(rows: DataFrame) -> DataFrame:
    """(status, n, share) of the audit statuses of a report."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy("status").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row
