"""From questions to pages: targets inferred or given, the hybrid chain in the mode of each question, synthesis, and the runs that watch it.

All questions go through one plan: the searches are made once for all of them, and only what hangs on the mode is made mode by mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import evaluation as E
from lodestone.operators import hybrid as H
from lodestone.operators import modes as M
from lodestone.operators import pages as P
from lodestone.operators import retrieval as R
from lodestone.operators import synthesis as Y
from lodestone.operators import vectors as D

MODES = ("paper", "variant", "assembly")
Store = Callable[[DataFrame, str], DataFrame]


def scopes(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, scope_source): the documents that a question is about, given with it (``override``) or inferred from its words.

    ``questions``: query_id, query, override (ids or null). ``docs``: as ``infer_targets`` takes them.
    """
    given = F.size(F.array_compact(F.coalesce("override", F.array().cast(questions.schema["override"].dataType)))) > 0
    over = questions.where(given).select("query_id", F.explode(F.array_distinct(F.array_compact("override"))).alias("doc_id"), F.lit("context_override").alias("scope_source"))
    inferred = R.infer_targets(questions.where(~given).select("query_id", "query"), docs)
    return over.unionByName(inferred.select("query_id", "doc_id", F.lit("inferred").alias("scope_source")))


def dense_run(queries: DataFrame, vectors: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, chunk_id, score, rank): nearest row numbers, turned into keys and passages. ``vectors``: row_id, doc_id, chunk_id, embedding."""
    near = R.dense_top(queries, vectors.select(F.col("row_id").alias("vec_id"), "embedding"), k).withColumnRenamed("vec_id", "row_id")
    return D.looked_up(near, vectors, passages.select("doc_id", "chunk_id")).select("query_id", "doc_id", "chunk_id", "score", "rank")


def candidate_types(pools: list[DataFrame], targets: DataFrame, passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, doc_type) of the documents that a run or a question names; no other text is looked at."""
    ids = targets.select("doc_id")
    for p in pools:
        ids = ids.union(p.select("doc_id"))
    ids = R.small(ids.distinct())
    first = R.annotate(passages.where("chunk_id < 8").join(ids, "doc_id", "left_semi"))
    name = F.col("doc_id").cast("string")
    titles = docs.join(ids, "doc_id", "left_semi").select("doc_id", name.alias("stem"), F.coalesce("title", name).alias("title"))
    return P.document_types(first, titles)


def review(questions: DataFrame, lib: R.Library, docs: DataFrame, vectors: DataFrame | None, encode: Callable[[Column], Column], stored: Store, k: int = 6) -> dict[str, DataFrame]:
    """Tables of a run: questions, targets, types, stages, decisions, final, synthesis, pages, warnings.

    ``questions``: query_id, query, mode, override, variant_id, phenotype, sample_id. ``docs``: doc_id, title, text, aliases.
    ``vectors``: see ``dense_run``; null, or a run that fails, leaves the sparse runs alone, with a warning for each question.
    """
    known = F.lower(F.coalesce("mode", F.lit("paper")))
    q = questions.withColumn("mode", F.when(known.isin(*MODES), known).otherwise("paper"))
    targets = stored(scopes(q, docs), "targets")
    source = targets.groupBy("query_id").agg(F.first("scope_source").alias("scope_source"), F.array_sort(F.collect_set("doc_id")).alias("targets"))
    q = stored(q.join(source, "query_id", "left").withColumn("scope_source", F.coalesce("scope_source", F.lit("none"))).withColumn("rewritten", X.rewrite(F.col("query"), F.col("mode"))), "questions")
    asked = q.select("query_id", F.col("rewritten").alias("query"))
    own = asked.select("query_id", encode(F.col("query")).alias("embedding")).where("embedding is not null")
    dense, warning = (None, "no vectors, sparse only") if vectors is None else D.attempted(lambda: dense_run(own, vectors, lib.passages, k), stored)
    found = H.searched(asked, lib, dense, "bm25", k, stored)
    types = stored(candidate_types(list(found.values()), targets, lib.passages, docs), "types")

    def similarity(pool: DataFrame) -> DataFrame:
        if dense is None:
            return pool.withColumn("sem", F.lit(None).cast("double"))
        both = pool.join(own.withColumnRenamed("embedding", "a"), "query_id", "left").join(vectors.select("doc_id", "chunk_id", F.col("embedding").alias("b")), ["doc_id", "chunk_id"], "left")
        return both.select("query_id", "doc_id", "chunk_id", R.inner_product(F.col("a"), F.col("b")).alias("sem"))

    parts: dict[str, DataFrame] = {}
    for mode in [r.mode for r in q.select("mode").distinct().collect()]:  # three at most
        this = q.where(F.col("mode") == mode).select("query_id")
        of = lambda df: df.join(this, "query_id", "left_semi")  # noqa: B023, E731
        name = lambda df, n: stored(df, f"{mode}-{n}")  # noqa: B023, E731
        stages, decisions, final = H.collect(of(asked), lib, of(targets.select("query_id", "doc_id")), similarity, None, "bm25", mode, k, name, types, {n: of(df) for n, df in found.items()})
        for n, df in (("stages", H.by_stage(stages)), ("decisions", decisions), ("final", final)):
            parts[n] = parts[n].unionByName(df) if n in parts else df
    final = stored(parts["final"], "final")
    kept = final.select("query_id", F.col("final_rank").alias("rank"), "doc_id", "chunk_id", "text", "summary", "short_tokens", "chunk_type", "doc_type", "records", "n_metrics")
    each = final.select("query_id", "final_rank", "doc_id", "chunk_id", F.posexplode("records").alias("at", "r"))
    records = each.select("query_id", (F.col("final_rank") * 10000 + F.col("at")).alias("pos"), "r.label", "r.value", "r.model", "r.dataset", "doc_id", "chunk_id")
    named = targets.select("query_id", "doc_id")
    paper = q.where(F.col("mode") == "paper").select("query_id", F.col("rewritten").alias("query"))
    synthesis = Y.verify(Y.build(paper, kept, records, named))
    pages = M.pages(q.select("query_id", F.col("rewritten").alias("query"), "mode", "variant_id", "phenotype", "sample_id"), kept, records, named)
    return {"questions": q, "targets": targets, "types": types, "stages": parts["stages"], "decisions": parts["decisions"], "final": final, "synthesis": synthesis, "pages": pages, "warnings": D.warnings(q, dense, warning)}


# ---------------------------------------------------------------- probes and validation


def is_deictic(query: Column) -> Column:
    return query.rlike(r"(?i)\bthis\b")


def probe_faults(probes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(slug, query_id, fault) of probes that can't be run: no such slug, nothing asked, or no document in the index."""
    m = manifest.select("slug", "expected")
    rows = probes.join(m.withColumn("there", F.lit(True)), "slug", "left")
    fault = F.when(F.col("there").isNull(), "not in the manifest").when(X.strip(F.coalesce("query", F.lit(""))) == "", "empty query").when(F.coalesce(F.size("expected"), F.lit(0)) <= 0, "no indexed document")
    return rows.withColumn("fault", fault).where("fault is not null").select("slug", "query_id", "fault")


def probe_questions(probes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Probes as questions in paper mode: one that says ``this`` is asked of the documents of its slug, others of what they name."""
    good = probes.join(probe_faults(probes, manifest).select("slug", "query_id"), ["slug", "query_id"], "left_anti").join(manifest.select("slug", "expected"), "slug")
    none = F.lit(None).cast("string")
    return good.select("query_id", "query", F.lit("paper").alias("mode"), F.when(is_deictic(F.col("query")), F.col("expected")).alias("override"), none.alias("variant_id"), none.alias("phenotype"), none.alias("sample_id"))


def integrity(manifest: DataFrame, types: DataFrame) -> DataFrame:
    """(slug, blocked, reasons): what the types of a slug's indexed documents say against its probes.

    ``manifest``: slug, modes, expected_doc_type, expected. ``types``: (doc_id, doc_type) of indexed documents.
    """
    seen = manifest.select("slug", F.explode("expected").alias("doc_id")).join(types, "doc_id").groupBy("slug").agg(F.collect_set("doc_type").alias("seen"))
    m = manifest.join(seen, "slug", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    has = lambda t: F.array_contains(F.transform("modes", lambda x: F.lower(F.trim(x))), t)
    primary = has("paper") & ~has("assembly") & ~has("variant")
    wanted = F.nullif(F.lower(F.trim(F.col("expected_doc_type"))), F.lit(""))
    some = F.size("seen") > 0
    reasons = F.array_compact(F.array(
        F.when(primary & F.exists("seen", lambda t: t != "paper"), F.lit("paper_primary_not_indexed_as_paper")),
        F.when(wanted.isNotNull() & some & ~F.array_contains("seen", wanted), F.concat(F.lit("expected_doc_type_mismatch:"), wanted)),
        F.when(wanted.isNotNull() & ~some, F.lit("expected_doc_type_unverifiable_no_indexed_doc")),
    ))
    return m.select("slug", primary.alias("paper_primary"), reasons.alias("reasons"), (F.size(reasons) > 0).alias("blocked"))


def answers(run: dict[str, DataFrame]) -> DataFrame:
    """(query_id, query, scope_source, targets, final_ids, status, metric_count and the sizes of a synthesis' lists) of the paper questions of a review."""
    final = run["final"].groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("final_ids"), F.sum("n_metrics").alias("metric_count"))
    size = lambda c: F.size(c).cast("long").alias(c)
    s = run["synthesis"].select("query_id", "status", size("claims"), size("unsupported"), size("limitations"), size("conflicts"))
    ids = F.array().cast(run["questions"].schema["targets"].dataType)
    out = run["questions"].select("query_id", "query", "scope_source", F.coalesce("targets", ids).alias("targets")).join(s, "query_id").join(final, "query_id", "left")
    return out.withColumn("final_ids", F.coalesce("final_ids", ids)).withColumn("metric_count", F.coalesce("metric_count", F.lit(0)).cast("long"))


def probe_rows(probes: DataFrame, manifest: DataFrame, run: dict[str, DataFrame], types: DataFrame) -> DataFrame:
    """A row a probe: how its documents were found, what the answer holds, and whether its slug's documents suit it."""
    meets = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    rows = probes.select("slug", "query_id", "task_type").join(manifest.select("slug", "expected"), "slug").join(answers(run), "query_id").join(integrity(manifest, types), "slug")
    return rows.withColumn("inferred", meets("expected", "targets")).withColumn("overlapping", meets("expected", "final_ids"))


def validation_rows(tasks: DataFrame, manifest: DataFrame, run: dict[str, DataFrame]) -> DataFrame:
    """A row a task with its checks and whether all pass. ``tasks``: slug, query_id, task_type, least_metrics."""
    rows = tasks.select("slug", "query_id", "task_type", "least_metrics").join(manifest.select("slug", "expected"), "slug").join(answers(run), "query_id")
    checks = E.auto_checks(*(F.col(c) for c in ("task_type", "expected", "targets", "final_ids", "status", "metric_count", "claims", "unsupported", "limitations", "conflicts")), F.coalesce("least_metrics", F.lit(1)))
    rows = rows.withColumn("checks", checks)
    return rows.withColumn("passed", F.forall(F.map_values("checks"), lambda x: x)).select("slug", "query_id", "task_type", "status", "checks", "passed")
