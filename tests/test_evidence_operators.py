"""Golden cases of single operators on literal rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import metrics as M
from lodestone.functions import text as X
from lodestone.operators import evaluation as E
from lodestone.operators import evidence as S
from lodestone.operators import quality as Q
from lodestone.operators import retrieval as R
from lodestone.sources import library as L
from lodestone.streaming import inbox


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_text_functions(spark):
    t = F.col("t")
    got = one(spark, X.clean_text(t), X.tokenize(t), X.short_tokens(t), X.dois(t), t="N50 is 1.5-2 (AUC)\n\n\n\n10.1234/Ab.c  x")
    assert got.c0 == "N 50 is 1.5 - 2 (AUC)\n\n10.1234/Ab.c x"
    assert got.c1 == ["n50", "is", "1.5-2", "auc", "10.1234/ab.c"] and got.c2 == ["auc"] and got.c3 == ["101234abc"]
    assert one(spark, X.normalize_text(F.lit("geno-\n mic ﬁt β Ω\r\nx"))).c0 == "genomic fit beta omega\nx"
    assert [one(spark, X.canonical_hgvs(F.lit(v))).c0 for v in ("c.123a>t", "p.(Arg1Cys)", "")] == ["c.123A>T", "p.ARG1CYS", "Unknown"]
    assert one(spark, X.rewrite(F.lit("a"), F.lit("paper")), X.rewrite(F.lit("[paper] a"), F.lit("paper"))) == ("[paper] a", "[paper] a")
    assert one(spark, X.overlap(F.array(F.lit("cat"), F.lit("dog")), F.lit("education")), X.overlap(F.array().cast("array<string>"), F.lit("x"))) == (0.5, 1.0)
    assert one(spark, X.informative(F.array(*map(F.lit, ["study", "auc", "cat", "genome", "assembly"])), "assembly")).c0 == ["auc", "genome"]
    assert one(spark, X.metric_intent(F.array(F.lit("p-value"))), X.metric_intent(F.array(F.lit("x")))) == (True, False)
    assert one(spark, X.safe_filename(F.lit("a b/c.txt")), X.slug(F.lit("A b_c")), X.tag(F.lit("Anti-over fit"))) == ("a_b_c.txt", "a-b-c", "anti_over_fit")


def test_classes(spark):
    kind = lambda t, table=False, noise=0.0: one(spark, C.chunk_type(F.lit(t), F.lit(table), F.lit(noise))).c0
    assert kind("a\nFigure 2 shows it") == "caption" and kind("Table 3. Values") == "table" and kind("zzzzzz word here longer") == "body"
    assert kind("100 200 300\n400 500 600") == "figure_derived" and kind("1.0 2.0 3.0\n4.0 5.0 6.0") == "mixed" and kind("x", True) == "figure_derived" and kind("a notable thing") == "table"
    got = one(spark, C.without_figure_noise(F.lit("0.1 0.2 0.3\nResults of the study are shown"), F.lit(True)), C.figure_noise(F.lit("0.1 0.2 0.3\nResults of the study are shown"), F.lit(True)))
    assert got == ("Results of the study are shown", 0.5)
    blob = lambda t: one(spark, C.doc_type(F.lit("x"), F.lit(t))).c0
    assert blob("busco and quast") == "assembly" and blob("clinvar missense") == "variant" and blob("busco") == "paper"
    assert one(spark, C.doc_type(F.lit("Shine_1"), F.lit(""))).c0 == "assembly"


def test_chunks(spark):
    text = "first para\n\n" + "b" * 1195 + "\n\n" + "c" * 3500 + "\n\nlast"
    rows = R.passages(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "doc_id int, text string")).orderBy("doc_id", "chunk_id").collect()
    own = [r.text for r in rows if r.doc_id == 1]
    assert own == ["first para", "first para\n\n" + "b" * 1195, "b" * 1195 + "\n\n" + "c" * 1700, "c" * 1700 + "\n\n" + "c" * 1700, "c" * 1700 + "\n\n" + "c" * 100, "c" * 100 + "\n\nlast"]
    assert [r.text for r in rows if r.doc_id != 1] == ["short"]


def test_metric_records():
    first = lambda t: M.extract(t)[0]
    assert (first("AUPR: 0.87")["label"], first("AUPR: 0.87")["value"], first("AUPR: 0.87")["task"]) == ("AUPR", "0.87", "PR-AUC")
    assert first("p = 7.0e-3")["label"] == "p-value" and first("p = 7.0e-3")["value"] == "7.0e-3"
    assert M.extract("doi: 10.1") == [] and M.extract("of SS: 3") == [] and M.extract(None) == []
    assert first("DYNA AUC = 0.9 versus ESM1b")["model"] == "DYNA" and first("AUC = 0.9 in gnomAD")["dataset"] == "gnomAD" and first("AUC = 0.9")["dataset"] == "Unknown"
    table = M.extract("Model Accuracy F1 score\nAlpha 0.91 0.80\nBeta 0.70 0.60\nend")
    assert [(r["model"], r["label"], r["value"]) for r in table][:2] == [("Alpha", "Accuracy", "0.91"), ("Alpha", "F1", "0.80")]
    family = {r["label"]: r["value"] for r in M.extract("VarCoPP: 95% confidence zone CS >= 0.5 and SS >= 80")}
    assert family["VarCoPP CS threshold (95% zone)"] == "0.5" and family["VarCoPP SS threshold (95% zone)"] == "80"
    assert {r["label"] for r in M.extract("SHINE balanced accuracy scores of 0.8 and 0.7 for deletions and insertions")} == {"SHINE balanced accuracy (deletions)", "SHINE balanced accuracy (insertions)"}


def test_meaningful_records(spark):
    ok = lambda label, value, task="", context="": one(spark, M.meaningful(*map(F.lit, (label, value, task, context)))).c0
    assert ok("AUC", "0.9") and ok("score", "0.9", "ROC-AUC")
    assert not any((ok("AUC", "2019"), ok("p-value", "3"), ok("Accuracy", "101"), ok("doi", "0.5"), ok("AUC", "x"), ok("size", "3")))
    assert one(spark, M.runtime_signal(F.lit("AUC: 0.9")), M.runtime_signal(F.lit("nothing"))) == (True, False)


# ---- quality filter, against a row-wise version


CANDIDATE = "query_id int, pos int, score double, terms array<string>, targets array<string>, doc_id string, chunk_id int, text string, summary string, chunk_type string, doc_type string, is_table_or_figure boolean, noise_level double, has_metrics boolean, runtime_signal boolean"


def candidate(pos, score, doc, text="protein folding", kind="body", noise=0.0, metrics=False, signal=False, terms=("protein", "folding"), targets=(), q=1):
    return (q, pos, score, list(terms), list(targets), doc, pos, text, text, kind, "paper", False, noise, metrics, signal)


def kept(spark, rows, k):
    out = Q.select(Q.scored(spark.createDataFrame(rows, CANDIDATE), "paper"), k).collect()
    return [r.doc_id for r in sorted(out, key=lambda r: r.final_rank)]


def test_quality_gates_and_rescues(spark):
    assert kept(spark, [candidate(1, 0.9, "a", "protein folding one"), candidate(2, 0.8, "b", "protein folding one"), candidate(3, 0.7, "c", "unrelated words")], 3) == ["a"]
    assert kept(spark, [candidate(1, 0.65, "o", "protein folding x"), candidate(2, 0.35, "t", "protein folding y", targets=["t"])], 1) == ["o"]
    both = [candidate(1, 0.65, "o", "protein folding x", targets=["t"]), candidate(2, 0.35, "t", "protein folding y", targets=["t"])]
    assert kept(spark, both, 1) == ["t"]
    assert kept(spark, [candidate(1, 0.9, "a", kind="caption")], 2) == [] and kept(spark, [candidate(1, 0.9, "a", kind="caption", metrics=True)], 2) == ["a"]
    many = [candidate(i, 1 - i / 100, "a", f"protein folding {i}") for i in range(1, 6)] + [candidate(9, 0.1, "b", "protein folding last")]
    assert kept(spark, many, 4) == ["a", "a", "b"]
    rescue = [candidate(1, 0.9, "a", "accuracy protein x", terms=("accuracy", "protein")), candidate(2, 0.2, "b", "accuracy protein y", metrics=True, terms=("accuracy", "protein"))]
    assert kept(spark, rescue, 1) == ["b"]


def test_selection_equals_row_wise_fold(spark):
    rng = random.Random(11)
    rows = [candidate(i, round(rng.random(), 3), rng.choice("abcd"), f"protein folding {rng.randrange(6)}", rng.choice(["body", "body", "table"]), metrics=rng.random() < 0.3, q=q) for q in range(8) for i in range(12)]
    frame = Q.scored(spark.createDataFrame(rows, CANDIDATE), "paper")
    facts = [r.asDict() for r in frame.collect()]
    got = {}
    for r in Q.select(frame, 4).collect():
        got.setdefault(r.query_id, []).append((r.final_rank, r.chunk_id))
    for q in range(8):
        chosen = []
        for r in sorted((f for f in facts if f["query_id"] == q and f["gate"] is None), key=lambda f: (-f["adjusted"], f["pos"])):
            mine = [c for c in chosen if c["doc_id"] == r["doc_id"]]
            if any(c["text"] == r["text"] for c in chosen) or len(mine) >= 2 or len(chosen) >= 4 or (r["figure"] and any(c["figure"] for c in mine) and not r["metric"]):
                continue
            chosen.append(r)
        assert [c for _, c in sorted(got.get(q, []))] == [c["chunk_id"] for c in chosen]


# ---- evidence, evaluation, state


def test_variants_and_lines(spark):
    rows = [("BRCA2 c.123A>T variant in ClinVar: Likely pathogenic. n = 42 cases and 10 controls of African ancestry", 1, "variant"), ("pharmacology of rs123", 0, "paper")]
    v = S.variant_fields(spark.createDataFrame(rows, "text string, n_metrics int, doc_type string"))
    a, b = v.withColumn("confidence", F.round(S.variant_confidence(v), 3)).collect()
    assert (a.variant_id, a.gene, a.clinvar, a.case_count, a.control_count, a.ancestry, a.confidence) == ("c.123A>T", "BRCA2", "Likely pathogenic", 42, 10, "African ancestry", 0.95)
    assert (b.variant_id, b.cohort, b.gene) == ("rs123", "arrhythmia cohort", "Unknown")
    lines = S.assembly_lines(spark.createDataFrame([(1, "N50: 12: kb\nnone\nBUSCO : 98%")], "doc_id int, text string")).collect()
    assert [(r["name"], r["value"]) for r in lines] == [("N50", "12: kb"), ("BUSCO", "98%")]


def test_audit_order(spark):
    f = lambda *a: one(spark, S.audit(*(F.lit(x) for x in a))).c0
    assert f(1, 0, False, False, False, False, 0, 0, False) == "supported" and f(0, 0, False, False, False, False, 0, 0, False) == "insufficient_evidence"
    assert f(1, 1, False, False, False, False, 0, 0, False) == "partially_supported" and f(2, 1, False, False, False, False, 0, 1, False) == "conflicting_evidence"
    assert f(1, 0, True, False, False, False, 0, 0, False) == "off_target_evidence" and f(1, 0, True, False, False, False, 0, 0, True) == "insufficient_evidence"
    assert f(1, 0, True, True, False, False, 0, 0, False) == "off_target_evidence" and f(1, 0, True, True, True, True, 0, 0, False) == "insufficient_evidence"


def test_targets(spark):
    docs = spark.createDataFrame([("d1", "Deep Genome Reader", ["genomereader"]), ("d2", "10.1234/abc.5", ["mendel"]), ("d3", "Other", ["abcd"])], "doc_id string, title string, aliases array<string>")
    queries = spark.createDataFrame([(1, "What does Deep Genome Reader say?"), (2, "see 10.1234/ABC.5"), (3, "this Mendel paper"), (4, "mendel results"), (5, "nothing")], "query_id int, query string")
    got = {(r.query_id, r.doc_id, r.strength) for r in R.infer_targets(queries, docs).collect()}
    assert got == {(1, "d1", "strong"), (2, "d2", "strong"), (4, "d2", "weak")}


def test_latency_and_state(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", None), ("c", 5.0)], "g string, v double")
    got = {r.g: (r.p50, r.p95, r["mean"]) for r in E.latency(rows, "g", "v").collect()}
    assert got == {"a": (10.5, 19.0, 10.5), "c": (5.0, 5.0, 5.0)}
    old = spark.createDataFrame([("s", 1, 1, "x")], "name string, created int, updated int, payload string")
    new = spark.createDataFrame([("s", 5, 5, "y"), ("t", 6, 6, "z")], old.schema)
    assert sorted(map(tuple, E.upsert(old, new, "name", "created", "updated").collect())) == [("s", 1, 5, "y"), ("t", 6, 6, "z")]
    checks = one(spark, E.auto_checks(F.lit("metric_extraction_query"), F.array(F.lit("a")), F.array(F.lit("a")), F.array(F.lit("b")), F.lit("supported"), *(F.lit(0) for _ in range(5)), F.lit(1))).c0
    assert checks == {"target_doc_inferred": True, "final_doc_overlap": False, "metric_minimum_met": False}


def test_sources_and_stream(spark, tmp_path):
    good = {"version": "1", "documents": [{"slug": "a", "title": "A", "filename": "a.pdf", "buckets": ["core"], "modes": ["paper"], "scope_aliases": ["x"]}]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(good))
    assert L.read_manifest(spark, str(path)).first().slug == "a"
    for change in ({"buckets": ["nope"]}, {"title": ""}):
        path2 = tmp_path / f"bad{len(change)}{list(change)[0]}.json"
        path2.write_text(json.dumps({"documents": [good["documents"][0] | change]}))
        with pytest.raises(ValueError):
            L.read_manifest(spark, str(path2))
    box = tmp_path / "inbox"
    box.mkdir()
    (box / "one.txt").write_text("First file here.")
    (box / "two.bin").write_text("not read")
    for n in (1, 2):
        inbox.sync(spark, f"file://{box}", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == n
        (box / "three.md").write_text("Second file.")
    assert [r.path.rsplit("/", 1)[1] for r in L.list_files(spark, str(box)).orderBy("path").collect()] == ["one.txt", "three.md"]
    L.write_manifest(spark, f"{tmp_path}/idx", {"dim": "64"})
    assert L.same_manifest(spark, f"{tmp_path}/idx", {"dim": "64"}) and not L.same_manifest(spark, f"{tmp_path}/idx", {"dim": "3"}) and not L.same_manifest(spark, f"{tmp_path}/none", {})


def test_latency_of_a_heavy_tail(spark):
    values = [1.0 + i / 1000 for i in range(2000)] + [10.0 ** i for i in range(3, 12)] + [float(-i) for i in range(50)]
    rows = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 7.0), ("c", None)], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in E.latency(rows, "g", "v").collect()}
    line = sorted(values)
    n = len(line)
    assert got == {"a": (round((line[(n - 1) // 2] + line[n // 2]) / 2, 6), round(line[int(0.95 * (n - 1))], 6)), "b": (7.0, 7.0)}
