"""The whole chain on small fixtures: stages, seeds, synthesis, verification, the page."""

from pyspark.sql import functions as F

from lodestone.operators import hybrid as H
from lodestone.operators import retrieval as R
from lodestone.operators import synthesis as Y
from lodestone.sources.tables import written


def library(spark, texts):
    passages = spark.createDataFrame([(d, 0, t) for d, t in texts], "doc_id string, chunk_id int, text string")
    lib = R.Library(passages)
    return R.Library(passages, {"terms": written(lib.terms, "terms"), "idf": written(lib.idf, "idf"), "norms": written(lib.norms, "norms")})


def none(pool):
    return pool.withColumn("sem", F.lit(0.0))


def test_seeds_join_where_no_run_finds_the_target(spark):
    texts = [(f"d{i}", f"protein folding kinetics in solvent number {i} with many helpful words") for i in range(4)] + [("t", "The accuracy of folding was AUC: 0.91 in this cohort of proteins, as we report here in detail.")]
    lib = library(spark, texts)
    q = spark.createDataFrame([(1, "protein folding kinetics solvent"), (2, "accuracy of folding solvent kinetics protein")], "query_id int, query string")
    targets = spark.createDataFrame([(1, "t"), (2, "t")], "query_id int, doc_id string")
    stages, decisions, final = H.collect(q, lib, targets, none, None, "bm25", "paper", 2, written)
    rows = {(r.query_id, r.stage, r.doc_id) for r in H.by_stage(stages).collect()}
    assert {s for _, s, _ in rows} >= {"primary", "fallback", "target_seed", "fused", "reranked", "final"}
    assert (1, "target_seed", "t") in rows and (1, "fused", "t") in rows and (1, "reranked", "t") in rows
    assert (2, "final", "t") in rows  # it asks for metrics, and this passage has one
    said = {(r.query_id, r.doc_id): (r.final_rank, r.reason) for r in decisions.collect()}
    assert all(reason.startswith("kept" if rank else "dropped") for rank, reason in said.values())
    kept = {(r.query_id, r.doc_id) for r in final.collect()}
    assert kept == {k for k, (rank, _) in said.items() if rank}
    none_named = H.runs(q, lib, targets.limit(0), None, "tfidf", None, 2)
    assert "target_seed" not in none_named and none_named["fused"].count() > 0


def synthesis(spark, query, kept, metrics=(), targets=()):
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    k = spark.createDataFrame([(1, i, d, 0, t, t, "body", 0) for i, (d, t) in enumerate(kept, 1)], "query_id int, rank int, doc_id string, chunk_id int, text string, summary string, chunk_type string, n_metrics int")
    m = spark.createDataFrame([(1, i, *x, 0) for i, x in enumerate(metrics)], "query_id int, pos int, label string, value string, model string, dataset string, doc_id string, chunk_id int")
    t = spark.createDataFrame([(1, d) for d in targets], "query_id int, doc_id string")
    return Y.build(q, k, m, t)


def test_passages_become_claims_and_missing_words_topics(spark):
    r = synthesis(spark, "protein folding", [("a", "protein folding is slow"), ("b", "other words"), ("c", "third"), ("d", "fourth")]).first()
    assert [c.statement for c in r.claims] == ["protein folding is slow", "other words", "third"] and r.status == "supported" and r.unsupported == [] and r.limitations == []
    r = synthesis(spark, "quantum gravity waves", [("a", "protein folding is slow")]).first()
    assert [u.topic for u in r.unsupported] == ["Query coverage for 'gravity'", "Query coverage for 'quantum'", "Query coverage for 'waves'"] and r.status == "partially_supported"
    assert synthesis(spark, "protein", []).first().status == "insufficient_evidence"


def test_targets_come_first_and_their_absence_shows(spark):
    r = synthesis(spark, "protein", [("a", "protein one"), ("t", "protein two")], targets=["t"]).first()
    assert [c.doc_id for c in r.claims] == ["t", "a"] and r.status == "supported"
    r = synthesis(spark, "protein", [("a", "protein one")], targets=["t"]).first()
    assert r.status == "off_target_evidence" and r.limitations == ["Target documents not represented: t", "Supported claims cite only non-target documents."]
    r = synthesis(spark, "What are the protein claims of the paper", [("a", "protein claims")], targets=["t"]).first()
    assert r.status == "insufficient_evidence" and r.claims == [] and "withholding" in r.limitations[0]


def test_metrics_conflict_and_verification(spark):
    two = [("AUC", "0.9", "M1", "X", "a"), ("auc", "0.8", "M2", "x", "b")]
    s = synthesis(spark, "which accuracy", [("a", "accuracy which")], two)
    r = s.first()
    assert [c.statement for c in r.claims] == ["M1 reported AUC=0.9 on X", "M2 reported auc=0.8 on x"] and r.status == "conflicting_evidence"
    assert r.conflicts == ["Conflicting AUC values on X: 0.9 (M1), 0.8 (M2)"]
    r = synthesis(spark, "accuracy", [("a", "accuracy")]).first()
    assert r.status == "insufficient_evidence" and r.unsupported[-1].topic == "Requested quantitative metrics" and r.claims == []
    text = Y.page(Y.verify(s)).first().page
    assert "1. M1 reported AUC=0.9 on X (Metric explicitly reported in cited passage.)" in text and "## Conflicts" in text and "render status: conflicting_evidence" in text
    bare = s.withColumn("claims", F.transform("claims", lambda c: c.withField("doc_id", F.lit(None).cast("string"))))
    v = Y.verify(bare).first()
    assert v.status == "insufficient_evidence" and v.claims == [] and v.dropped == 2 and len(v.unsupported) == 2
    r = synthesis(spark, "protein", [("a", "protein folding improved"), ("b", "protein folding got worse")]).first()
    assert r.conflicts == ["Narrative disagreement on folding/protein: 'protein folding improved' vs 'protein folding got worse'"]
