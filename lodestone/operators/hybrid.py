"""Hybrid collection: sparse and dense runs, seeds of named documents, fusion, reranking and the quality filter, for all queries at once.

Every stage is a table keyed by ``query_id``; candidates are joined with texts only where a stage reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import metrics as M
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import quality as Q
from lodestone.operators import reports as P
from lodestone.operators import retrieval as R

_KEY = ["query_id", "doc_id", "chunk_id"]


def _described(picks: DataFrame, queries: DataFrame, targets: DataFrame, passages: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Picked passages with texts, classes, metrics, the query's terms and its targets. ``types``: (doc_id, doc_type); documents without are papers."""
    named = targets.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("targets"))
    asked = queries.join(named, "query_id", "left").select("query_id", "query", X.tokenize(F.col("query")).alias("terms"), F.coalesce("targets", F.array().cast(named.schema["targets"].dataType)).alias("targets"))
    out = R.annotate(picks.join(passages, ["doc_id", "chunk_id"]).join(R.small(asked), "query_id"))
    records = F.when(F.col("raw_text").rlike("(?i)" + V.METRIC_SIGNAL), M.extract_metrics(F.col("raw_text")))
    good = F.filter(F.coalesce(records, F.array().cast(M.RECORD)), lambda r: M.meaningful(r["label"], r["value"], r["task"], r["context"]))
    out = out.withColumn("records", good).withColumn("n_metrics", F.size("records")).withColumn("has_metrics", F.size("records") > 0).withColumn("runtime_signal", F.size("records") > 0)
    if types is None:
        return out.withColumn("doc_type", F.lit("paper"))
    return out.join(types.select("doc_id", "doc_type"), "doc_id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("paper")))


def searched(queries: DataFrame, lib: R.Library, dense: DataFrame | None = None, method: str = "bm25", k: int = 6, stored=lambda df, name: df) -> dict[str, DataFrame]:
    """The runs that hang on no mode: primary, fallback and, where there are vectors, dense."""
    cols = [*_KEY, "score", "rank"]
    out = {"primary": R.search(queries, lib, method, k).select(*cols), "fallback": R.search(queries, lib, "tfidf" if method == "bm25" else "bm25", k).select(*cols)}
    if dense is not None:
        out["dense"] = dense.where(F.col("rank") <= k).select(*cols)
    return {name: stored(df, name) for name, df in out.items()}


def metric_seeds(c: DataFrame, mode: str = "paper", most: int = 2) -> DataFrame:
    """(query_id, doc_id, chunk_id, score) of the best passages with metrics of a query's targets; of equal texts one."""
    info = X.informative(F.col("terms"), mode)
    low = F.lower(F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    over = X.overlap(F.col("terms"), low)
    own = F.when(F.size(info) > 0, X.overlap(info, low)).otherwise(over)
    noise = C.effective_noise(F.col("text"), F.col("chunk_type"), F.col("is_table_or_figure"), F.col("noise_level"))
    labels = P.label_overlap(F.col("terms"), F.flatten(F.transform("records", lambda r: F.array(r["label"], r["task"]))))
    score = P.metric_seed(over, own, noise, C.is_boilerplate(F.col("text")), F.col("n_metrics"), F.col("runtime_signal"), labels, F.col("chunk_type"), C.mode_context(F.col("doc_type"), mode))
    scored = c.withColumn("score", F.round(score, 6)).where("score is not null").withColumn("print", X.fingerprint(F.coalesce("text", "summary", F.lit(""))))
    first = F.row_number().over(Window.partitionBy("query_id", "print").orderBy(F.col("score").desc(), "doc_id", "chunk_id"))
    best = scored.withColumn("n", first).where("n = 1")
    return R.top(best.select(*_KEY, "score"), most, ["doc_id", "chunk_id"])


def runs(queries: DataFrame, lib: R.Library, targets: DataFrame, dense: DataFrame | None = None, method: str = "bm25", mode: str | None = "paper", k: int = 6, stored=lambda df, name: df, types: DataFrame | None = None, found: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """(query_id, doc_id, chunk_id, score, rank) by stage: primary, fallback, dense, target_seed, target_metric_seed, fused.

    Seeds are looked for in paper mode only: a target's best passages where no other run found a target, and those with
    metrics, which join the candidates after fusion, where a query asks for metrics. ``found`` are runs of these queries that
    were made before.
    """
    cols = [*_KEY, "score", "rank"]
    out = dict(found) if found is not None else searched(queries, lib, dense, method, k, stored)
    pools = None
    for r in out.values():
        pools = r.select(*_KEY) if pools is None else pools.union(r.select(*_KEY))
    if mode == "paper":
        found = pools.join(R.small(targets), ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
        measuring = queries.where(F.coalesce(X.metric_intent(X.tokenize(F.col("query"))), F.lit(False))).select("query_id")
        lost = R.small(targets).join(found, "query_id", "left_anti").withColumn("lost", F.lit(True))
        wanted = lost.unionByName(R.small(targets).join(measuring, "query_id", "left_semi").withColumn("lost", F.lit(False)))
        own = wanted.join(lib.passages.select("doc_id", "chunk_id"), "doc_id").groupBy(*_KEY).agg(F.bool_or("lost").alias("lost"))
        named = stored(_described(own, queries, targets, lib.passages, types), "named")
        out["target_seed"] = stored(P.target_seeds(named.where("lost").withColumn("found_target", F.lit(False)), mode, min(2, max(1, k))).select(*cols), "target_seed")
        rest = named.join(measuring, "query_id", "left_semi").join(pools.distinct(), _KEY, "left_anti")
        out["target_metric_seed"] = stored(metric_seeds(rest, mode, min(2, max(1, k))).select(*cols), "target_metric_seed")
    fused = [df for name, df in out.items() if name != "target_metric_seed"]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id", "chunk_id")
    out["fused"] = stored(R.fuse(fused, ["doc_id", "chunk_id"]).withColumn("rank", F.row_number().over(order)).select(*cols), "fused")
    return out


def rerank(stages: dict[str, DataFrame], queries: DataFrame, lib: R.Library, targets: DataFrame, similarity: Callable[[DataFrame], DataFrame], k: int = 6, types: DataFrame | None = None) -> DataFrame:
    """The candidates by similarity and lexical overlap: 2 k of them, 3 k with targets.

    ``similarity`` adds ``sem`` (none: 0) to (query_id, doc_id, chunk_id) rows, so it is taken of candidates only.
    """
    pool = stages["fused"].select(*_KEY)
    if "target_metric_seed" in stages:
        pool = pool.union(stages["target_metric_seed"].select(*_KEY)).distinct()
    c = _described(similarity(pool), queries, targets, lib.passages, types)
    score = R.rerank_score(F.coalesce("sem", F.lit(0.0)), R.lexical_overlap(F.col("query"), F.col("text")), F.col("noise_level"), F.col("is_table_or_figure"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id", "chunk_id")
    most: Column = F.when(F.size("targets") > 0, 3 * k).otherwise(2 * k)
    return c.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("pos", F.col("rank"))


def collect(queries: DataFrame, lib: R.Library, targets: DataFrame, similarity: Callable[[DataFrame], DataFrame], dense: DataFrame | None = None, method: str = "bm25", mode: str | None = "paper", k: int = 6, stored=lambda df, name: df, types: DataFrame | None = None, found: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(stages, decisions of the filter, described final passages). ``stored`` may write a stage and read it again, so that none is computed twice."""
    stages = runs(queries, lib, targets, dense, method, mode, k, stored, types, found)
    best = stored(rerank(stages, queries, lib, targets, similarity, k, types), "reranked")
    decisions = stored(Q.decide(Q.scored(best, mode), k), "decisions")
    final = decisions.where("final_rank is not null").select(*_KEY, "final_rank").join(best, _KEY)
    cols = [*_KEY, "score", "rank"]
    stages["reranked"] = best.select(*cols)
    stages["final"] = final.select(*_KEY, "score", F.col("final_rank").alias("rank"))
    return stages, decisions, final


def by_stage(stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, stage, doc_id, chunk_id, score, rank) of all stages."""
    out = None
    for name, df in stages.items():
        rows = df.select("query_id", F.lit(name).alias("stage"), "doc_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return out
