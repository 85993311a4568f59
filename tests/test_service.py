"""Vectors by row number, questions encoded once, pages by mode; seeds and the filter against loops over all questions."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import hybrid as H
from lodestone.operators import modes as M
from lodestone.operators import retrieval as R
from lodestone.operators import service as Z
from lodestone.operators import vectors as D
from lodestone.plans import review_queries as Q
from lodestone.sources import tables as S

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- vectors


def test_rows_are_numbered_without_gaps_in_order(spark):
    keys = [(d, c) for d in (0, 1, 2, 7, 8, 100, 101, 5000) for c in range(d % 3 + 1)]
    rows = spark.createDataFrame([(d, c, f"{d}:{c}") for d, c in reversed(keys)] + [(None, 0, "no key")], "doc_id long, chunk_id int, text string")
    got = {(r.doc_id, r.chunk_id): r.row_id for r in D.numbered(rows, ["doc_id", "chunk_id"], D.by_stretch("doc_id", 4)).collect()}
    assert [got[k] for k in keys] == list(range(len(keys))) and len(got) == len(keys)
    index = D.numbered(rows, ["doc_id", "chunk_id"], D.by_stretch("doc_id", 4)).drop("text")
    hits = spark.createDataFrame([(i, n) for i, n in enumerate([0, -1, len(keys), 3])], "hit int, row_id long")
    left = rows.where("doc_id is not null and doc_id <> 2")
    assert sorted((r.hit, r.text) for r in D.looked_up(hits, index, left).collect()) == [(0, "0:0")]  # number 3 is of document 2
    assert {r.hit: r.state for r in D.access(hits, index, left).collect()} == {0: "found", 1: "out of range", 2: "out of range", 3: "no passage"}
    assert D.numbered(rows.limit(0), ["doc_id"], D.by_stretch("doc_id")).count() == 0


def test_questions_of_one_key_are_encoded_once(spark):
    q = spark.createDataFrame([(1, "Protein Folding"), (2, " protein folding "), (3, "  "), (4, None), (5, "known one"), (6, "!!")], "query_id int, query string")
    known = spark.createDataFrame([("known one", [1.0, 0.0])], "key string, embedding array<double>")
    vectors, new, counts = D.encode_once(q, known, lambda c: D.hashed(c, 2))
    assert sorted(r.key for r in new.collect()) == ["!!", "protein folding"]
    assert counts.first().asDict() == {"hits": 2, "misses": 2, "asked": 4}
    got = {r.query_id: r.embedding for r in vectors.collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[2] and got[5] == [1.0, 0.0] and abs(sum(x * x for x in got[1]) - 1) < 1e-12
    again = D.encode_once(q, known.unionByName(new), lambda c: F.lit(None).cast("array<double>"))
    assert again[1].count() == 0 and again[2].first().misses == 0 and {r.query_id: r.embedding for r in again[0].collect()} == got


def test_a_dense_run_that_fails_leaves_sparse_ones(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "")], "query_id int, query string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("nan"), 0.0]), (2, [1.0]), (3, None), (4, [None, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in D.usable(vectors, 2).collect()] == [0]
    three = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    run, warning = D.attempted(lambda: R.dense_top(three, D.usable(vectors, 2), 1), S.written)
    assert run is None and warning.startswith("dense unavailable, sparse only")
    assert {r.query_id: r.warning for r in D.warnings(q, run, warning).collect()} == {1: warning, 2: warning}
    two = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    run, warning = D.attempted(lambda: R.dense_top(two, D.usable(vectors, 2), 1), S.written)
    assert warning is None and [(r.query_id, r.warning) for r in D.warnings(q, run, warning).collect()] == [(2, "no vector, sparse only")]


# ---------------------------------------------------------------- pages by mode


RECORD = "array<struct<label:string,value:string,model:string,dataset:string,task:string>>"
KEPT = f"query_id int, rank int, doc_id string, chunk_id int, text string, summary string, short_tokens array<string>, chunk_type string, doc_type string, records {RECORD}, n_metrics int"
ASKED = "query_id int, query string, mode string, variant_id string, phenotype string, sample_id string"


def kept(spark, *rows):
    return spark.createDataFrame([(q, i, d, 0, t, None, s, "body", kind, r, len(r)) for i, (q, d, t, s, kind, r) in enumerate(rows, 1)], KEPT)


def test_variant_bundle_counts_and_contradicts(spark):
    k = kept(
        spark,
        (1, "a", "MYH7 c.123A>G is pathogenic by ClinVar in 12 cases", ["cm"], "variant", [("AUC", "0.9", "DYNA", "ClinVar", "ROC-AUC")]),
        (1, "b", "MYH7 c.123A>G is benign by ClinVar", ["afr"], "paper", []),
        (1, "c", "nothing to see", [], "paper", []),
        (2, "c", "nothing to see", [], "paper", []),
    )
    asked = spark.createDataFrame([(1, "which variants seen with benign outcome, unheard", "variant", None, None, None), (2, "nothing", "variant", "c.5A>T", None, None), (3, "alone", "variant", None, None, None)], ASKED)
    b = {r.query_id: r for r in M.variant_bundle(k, asked).collect()}
    assert (b[1].total_passages, b[1].candidates, b[1].ancestries) == (3, 2, 0)
    assert b[1].missing == ["ancestry context", "control counts", "population frequency"]
    assert b[1].contradictions == ["Conflicting ClinVar significance for c.123A>G: Benign, Pathogenic"]
    assert b[1].uncovered == ["outcome", "unheard", "variants", "which"]
    assert b[1].notes[1] == "Short-token hints observed (needs confirmation): afr, cm"
    assert [(x.doc_id, x.confidence, x.reason) for x in b[1]["items"]] == [("a", 0.95, "variant id, gene mention, clinvar classification, metrics, variant doc"), ("b", 0.85, "variant id, gene mention, clinvar classification")]
    assert b[1]["items"][0].cohort == "cardiomyopathy cohort" and b[1]["items"][0].case_count == 12
    assert b[2].candidates == 1 and b[2]["items"][0].variant_id == "c.5A>T"  # the variant that the question names is taken for that of each passage
    assert b[3].total_passages == 0 and len(b[3].missing) == 6
    page = {r.query_id: r.page for r in M.variant_page(M.variant_bundle(k, asked)).collect()}
    assert "- c.123A>G (MYH7) · Pathogenic" in page[1] and "  Metric: AUC=0.9" in page[1] and "## Contradictions" in page[1] and V.MODE_NOTES["no variants"] in page[3]


def test_three_modes_under_one_schema(spark):
    k = kept(spark, (1, "a", "protein folding is slow", [], "paper", []), (2, "b", "N50: 12\nno measure\nBUSCO: 95: %", [], "assembly", []), (3, "b", "no measure", [], "assembly", []), (4, "v", "MYH7 variant", [], "variant", []))
    asked = spark.createDataFrame([(1, "protein", None, None, None, None), (2, "n50", "Assembly", None, None, "s1"), (3, "n50", "assembly", None, None, None), (4, "myh7", "variant", None, "epilepsy", None), (5, "none kept", "paper", None, None, None)], ASKED)
    none = spark.createDataFrame([], "query_id int, pos int, label string, value string, model string, dataset string, doc_id string, chunk_id int")
    got = {r.query_id: (r.mode, r.page) for r in M.pages(asked, k, none, spark.createDataFrame([], "query_id int, doc_id string")).collect()}
    assert {q: m for q, (m, _) in got.items()} == {1: "paper", 2: "assembly", 3: "assembly", 4: "variant"}
    assert got[2][1] == "Assembly QC report for s1\n- N50: 12\n- BUSCO: 95: %" and got[3][1].endswith("Warnings:\n  * " + V.MODE_NOTES["no metrics"]) and got[3][1].startswith("Assembly QC report for sample")
    assert "Phenotype hint: epilepsy" in got[4][1] and "  Phenotype: epilepsy" in got[4][1] and "protein folding is slow" in got[1][1]


# ---------------------------------------------------------------- probes


def test_integrity_and_faults(spark):
    m = spark.createDataFrame(
        [("a", ["Paper"], "paper", ["1"]), ("b", ["paper"], None, ["2"]), ("c", ["paper", "variant"], "variant", ["1"]), ("d", ["paper"], "paper", ["9"]), ("e", ["paper"], " ", [])],
        "slug string, modes array<string>, expected_doc_type string, expected array<string>",
    )
    types = spark.createDataFrame([("1", "paper"), ("2", "assembly")], "doc_id string, doc_type string")
    got = {r.slug: r.reasons for r in Z.integrity(m, types).collect()}
    assert got == {"a": [], "b": ["paper_primary_not_indexed_as_paper"], "c": ["expected_doc_type_mismatch:variant"], "d": ["expected_doc_type_unverifiable_no_indexed_doc"], "e": []}
    p = spark.createDataFrame([("a", "1", "What does this say"), ("a", "2", "thistle"), ("z", "3", "x"), ("b", "4", " "), ("e", "5", "x")], "slug string, query_id string, query string")
    assert {(r.slug, r.fault) for r in Z.probe_faults(p, m).collect()} == {("z", "not in the manifest"), ("b", "empty query"), ("e", "no indexed document")}
    assert {r.query_id: r.override for r in Z.probe_questions(p, m).collect()} == {"1": ["1"], "2": None}


# ---------------------------------------------------------------- the whole run, by loops


@pytest.fixture(scope="module")
def run(spark):
    r = Q._reviewed(spark, SF)
    docs = Q._reports(spark, SF)
    lib = type("Lib", (), {"passages": R.passages(docs)})
    q = r["questions"].select("query_id", F.col("rewritten").alias("query"))
    stages = r["stages"].toPandas()
    wanted = spark.createDataFrame(stages[["query_id", "doc_id", "chunk_id"]].drop_duplicates())
    own = r["targets"].join(lib.passages.select("doc_id", "chunk_id"), "doc_id").select("query_id", "doc_id", "chunk_id")
    described = H._described(wanted.unionByName(own).distinct(), q, r["targets"], lib.passages, r["types"]).drop("raw_text")
    facts = {(x.query_id, x.doc_id, x.chunk_id): x for x in described.collect()}
    mode = {x.query_id: x["mode"] for x in r["questions"].collect()}
    return r, stages, facts, mode


def share(terms, low):
    terms = set(terms)
    return sum(t in low for t in terms) / len(terms) if terms else 1.0


def seen_as(x, mode):
    """What the seeds and the filter look at, of one row."""
    low = f"{x.summary or ''} {x.text or ''}".lower()
    info = [t for t in x.terms if t not in V.MODE_KEYWORDS.get(mode, []) and t not in V.QUERY_STOPWORDS and (len(t) >= 5 or t in V.SHORT_TOKENS)]
    over = share(x.terms, low)
    figure = x.is_table_or_figure or x.chunk_type in ("caption", "figure_derived", "table", "mixed")
    digits = len(re.findall(r"\d", x.text)) / max(1, len(x.text))
    noise = x.noise_level if x.noise_level > 0 else digits if figure else 0.0
    intent = any(re.sub("[^a-z0-9]+", "", t) in V.METRIC_QUERY_TERMS for t in x.terms)
    context = x.doc_type in ("paper", "unknown") if mode == "paper" else x.doc_type == mode
    return low, info, over, share(info, low) if info else over, figure, noise, intent, context


def test_seeds_by_loops(run):
    r, stages, facts, mode = run
    pools = stages[stages.stage.isin(["primary", "fallback", "dense"])].groupby("query_id").doc_id.agg(set).to_dict()
    by = {}
    for (q, d, c), x in facts.items():
        if mode[q] == "paper" and d in x.targets and not pools.get(q, set()) & set(x.targets):
            _, _, over, own, figure, noise, _, context = seen_as(x, "paper")
            if over < 0.2 or noise > 0.5 or (figure and not x.has_metrics and own < 0.6):
                continue
            score = 0.7 * over + 0.3 * own + 0.03 * x.has_metrics - (0 if context else 0.12) - min(0.2, 0.2 * noise)
            by.setdefault(q, {}).setdefault(d, []).append((-round(score, 6), c))
    want = {(q, d, min(cs)[1], -min(cs)[0]) for q, ds in by.items() for d, cs in sorted(ds.items(), key=lambda kv: (min(kv[1])[0], kv[0]))[:2]}
    got = {(x.query_id, x.doc_id, x.chunk_id, x.score) for x in stages[stages.stage == "target_seed"].itertuples()}
    assert len(got) > 5 and {x[:3] for x in got} == {x[:3] for x in want}
    assert all(abs(s - {x[:3]: x[3] for x in want}[q, d, c]) < 2e-6 for q, d, c, s in got)
    assert set(stages.stage) == {"primary", "fallback", "dense", "target_seed", "target_metric_seed", "fused", "reranked", "final"}


def chosen(rows, mode, k=6):
    """(place, reason, rank) by the rules of the filter, one row after the other."""
    out, line, seen = {}, [], {x.doc_id for _, _, x in rows}
    for place, score, x in rows:
        low, info, over, own, figure, noise, intent, context = seen_as(x, mode)
        own = share(info, low)
        figured = (0.15 if x.has_metrics else 0.25) if figure else 0.0
        penalty = min(0.85, 0.8 * noise + figured)
        weight, target = 1.0, x.doc_id in x.targets
        if mode != "paper":
            hits, against = sum(w in low for w in V.MODE_KEYWORDS[mode]), sum(w in low for w in V.MODE_NEGATIVE[mode])
            kind = 0.0 if x.doc_type == "paper" else 0.2 if x.doc_type == mode else -0.25
            weight = 0.6 if not hits else max(0.4, min(1.6, min(1.4, 1 + 0.18 * hits) - min(0.3, 0.1 * against) + kind))
        if seen & set(x.targets):
            weight = max(0.4, min(1.8, weight * (1.25 if target else 0.65)))
        adjusted = score * weight * (1 - penalty) * (0.1 if over == 0 else 0.4 + 0.6 * over)
        scoped = mode == "paper" and intent and bool(x.targets)
        close = over >= 0.3 and penalty <= 0.4
        signal = scoped and target and figure and not x.has_metrics and close and (not info or own >= 0.2) and x.runtime_signal
        metric, strong = x.has_metrics or signal, bool(info) and own >= 0.6
        reason = None
        if figure and not x.has_metrics and not signal and not (target and (strong or over >= 0.6)):
            reason = "bare figure"
        elif figure and x.has_metrics and not (strong or context or (scoped and target and close and own >= 0.15)):
            reason = "off figure"
        elif info and own == 0 and not (target and close) and not (intent and metric and over > 0):
            reason = "uninformative"
        elif over == 0:
            reason = "no overlap"
        fact = dict(place=place, x=x, adjusted=adjusted, figure=figure, metric=metric, target=target, close=close, own=own, over=over, penalty=penalty, intent=intent)
        out[place] = [reason and V.REASONS[reason], None]
        if reason is None:
            line.append(fact)
    line.sort(key=lambda f: (-f["adjusted"], f["place"]))
    kept, prints = [], set()
    for f in line:
        if len(kept) == k:
            break
        same = [g for g in kept if g["x"].doc_id == f["x"].doc_id]
        key = " ".join((f["x"].text or "").lower().split())
        if key in prints:
            out[f["place"]][0] = V.REASONS["duplicate"]
        elif len(same) >= max(2, k // 2):
            out[f["place"]][0] = V.REASONS["document"]
        elif f["figure"] and not f["metric"] and any(g["figure"] for g in same):
            out[f["place"]][0] = V.REASONS["figure"]
        else:
            kept.append(f)
            prints.add(key)
    x = rows[0][2]
    _, _, _, _, _, _, intent, _ = seen_as(x, mode)

    def swap(f, at, why):
        if at is not None:
            out[kept[at]["place"]][0] = f"{V.REASONS['replaced']} {f['x'].doc_id}:{f['x'].chunk_id}"
            kept[at] = f
        else:
            kept.append(f)
        out[f["place"]][0] = V.REASONS[why]

    others = lambda: [f for f in line if f not in kept]
    if x.targets and kept and not any(f["target"] for f in kept):
        at = min(range(len(kept)), key=lambda i: kept[i]["adjusted"])
        for f in others():
            if f["target"] and (f["close"] or f["own"] >= 0.2 or (intent and f["x"].has_metrics)) and f["adjusted"] + 0.05 >= kept[at]["adjusted"]:
                swap(f, at, "target rescue")
                break
    if x.targets and not kept:
        for f in others():
            if f["target"] and f["penalty"] <= 0.55 and (not f["figure"] or f["x"].has_metrics):
                swap(f, None, "target rescue")
                break
    if intent and kept and not any(f["metric"] for f in kept):
        for f in others():
            if f["metric"] and (f["over"] > 0 or f["own"] > 0):
                swap(f, len(kept) - 1, "metric rescue")
                break
    for i, f in enumerate(kept, 1):
        out[f["place"]][1] = i
    return {p: (why or V.REASONS["kept" if rank else "below"], rank) for p, (why, rank) in out.items()}


def test_filter_by_loops(run):
    r, stages, facts, mode = run
    rows = {}
    for x in stages[stages.stage == "reranked"].itertuples():
        rows.setdefault(x.query_id, []).append((x.rank, x.score, facts[x.query_id, x.doc_id, x.chunk_id]))
    want = {}
    for q, own in rows.items():
        own.sort(key=lambda t: t[0])
        for place, said in chosen(own, mode[q]).items():
            x = next(f for p, _, f in own if p == place)
            want[q, x.doc_id, x.chunk_id] = said
    got = {(x.query_id, x.doc_id, x.chunk_id): (x.reason, x.final_rank) for x in r["decisions"].collect()}
    assert got.keys() == want.keys() and len({re.sub(r"\d+:\d+", "", why) for why, _ in got.values()}) >= 7
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}
