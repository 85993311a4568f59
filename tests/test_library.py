"""Pages, reloading and repair, report graphs, rules, marks and abbreviations against loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import highlight as H
from lodestone.functions import values as V
from lodestone.operators import evaluation as E
from lodestone.operators import pages as P
from lodestone.operators import retrieval as R
from lodestone.sources import repair, reports, rules


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- pages


def test_numbers_run_on_through_pages(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 2)
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "x" * 900, "y" * 1800]
    pages = [(d, p, "\n\n".join(rng.choice(words) + f" {i}" for i in range(rng.randint(0, 6)))) for d in ("a", "b") for p in range(1, 8)]
    pages += [("c", None, "one file\n\nwithout pages"), ("d", 1, None), ("d", 2, "  ")]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    want, seen = [], {}
    for doc, page, text in pages:
        cut = R.passages(spark.createDataFrame([("k", text)], "doc_id string, text string")).orderBy("chunk_id").collect()
        for r in cut:
            want.append((doc, page, seen.setdefault(doc, 0), r["text"]))
            seen[doc] += 1
    assert rows(P.page_passages(df)) == sorted(want, key=str) and len({w[0] for w in want}) == 3


def kind_by_loops(stem, title, samples):
    if "shine" in stem.lower():
        return "assembly"
    blob = " \n".join([stem.lower(), *(t.lower() for t in [title, *samples] if t)])
    a, v = (sum(w in blob for w in V.DOC_TYPE_KEYWORDS[k]) for k in ("assembly", "variant"))
    return "assembly" if a >= max(2, v + 1) else "variant" if v >= max(2, a + 1) else "paper"


def test_types_come_from_name_title_and_first_chunks(spark):
    a, v = V.DOC_TYPE_KEYWORDS["assembly"], V.DOC_TYPE_KEYWORDS["variant"]
    long = ["filler " * 200 + f"n{i}" for i in range(9)]
    docs = {
        "a": ("x/plain.txt", [f"First line here\nabout {a[0]} and {a[1]}"]), "v": ("x/plain.pdf", [f"Title of it\n{v[0]}", f"{v[1]} too"]), "tie": ("p.txt", [f"Title {a[0]} {a[1]} {v[0]} {v[1]}"]),
        "one": ("p.txt", [f"Only {v[0]}"]), "late": ("p.txt", [*long, f"{v[0]} {v[1]} {v[2]}"]), "s": ("dir/MyShine_run.txt", ["nothing"]), "none": ("p.txt", [""]),
    }
    pages = spark.createDataFrame([(d, i, t) for d, (_, ts) in docs.items() for i, t in enumerate(ts)], "doc_id string, page int, text string")
    paths = spark.createDataFrame([(d, p) for d, (p, _) in docs.items()], "doc_id string, source_path string")
    out = P.index_pages(pages, paths)
    got = {r["doc_id"]: r["doc_type"] for r in out.select("doc_id", "doc_type").distinct().collect()}
    want = {}
    for d, (path, ts) in docs.items():
        own = [r["summary"] or r["text"] for r in out.where(F.col("doc_id") == d).orderBy("chunk_id").limit(8).collect()]
        first = ts[0].strip().split("\n")[0]
        stem = path.split("/")[-1].rsplit(".", 1)[0]
        if own:
            want[d] = kind_by_loops(stem, first if 6 <= len(first) <= 120 else stem, own)
    assert got == want and set(got.values()) == {"assembly", "variant", "paper"} and got["late"] == "paper"


# ---- reload and repair


def record(i, **more):
    passages = [{"doc_id": f"d{i}", "source_path": f"in/d{i}.txt", "page": None, "chunk_id": j, "text": t, "chunk_type": "body", "doc_type": "paper"} for j, t in enumerate(["gene gene assay", "more text of it"])]
    counts = [{"gene": 2, "assay": 1}, {"more": 1, "text": 1, "of": 1, "it": 1}]
    return {"doc_id": f"d{i}", "source_path": f"in/d{i}.txt", "ext": "txt", "title": "T", "doc_type": "paper", "passages": passages, "vectors": counts, "term_counts": counts, "doc_lengths": [3, 4]} | more


def test_bad_lines_are_warnings_and_stale_records_are_repaired_once(spark, tmp_path):
    p = record(0)["passages"]
    v = V.DOC_TYPE_KEYWORDS["variant"]
    cases = {
        "ok": record(0), "counts": record(1, term_counts=[]), "lengths": record(2, doc_lengths=[1]), "vectors": record(3, vectors=None), "kinds": record(4, passages=[p[0] | {"chunk_type": "unknown"}, p[1] | {"chunk_type": None}]),
        "type": record(5, title=f"{v[0]} {v[1]}"), "own type": record(6, passages=[p[0], p[1] | {"doc_type": "variant"}]), "no doc type": record(7, doc_type=None), "no passages": record(8, passages=[], vectors=[], term_counts=[], doc_lengths=[]),
        "missing": {k: x for k, x in record(9).items() if k != "ext"}, "unknown field": record(10, passages=[p[0] | {"color": "red"}]), "less": record(11, passages=[{k: x for k, x in p[0].items() if k != "page"}]), "more at the top": record(12, new_field=3),
    }
    lines = [json.dumps(c) for c in cases.values()] + ['{"doc_id": "cut', "[1, 2]", "", "null", json.dumps(record(13, passages="text"))]
    store = repair.LibraryStore(spark, f"file://{tmp_path}/s")
    assert store.load().count() == 0 and not store.repair()
    store.save(spark.createDataFrame([(x,) for x in lines], "value string"))
    said = lambda: {r["doc_id"] or r["value"][:24]: (r["warning"], r["repairs"]) for r in store.load().collect()}
    got = said()
    fine = lambda *names: (None, list(names))
    assert {k: got[k] for k in got if k.startswith("d")} == {
        "d0": fine(), "d1": fine("term counts"), "d2": fine("term counts"), "d3": fine("vectors"), "d4": fine("chunk types"), "d5": fine("document type"), "d6": fine("document type"), "d7": fine(), "d8": fine(), "d12": fine(),
    }
    bad = sorted(w for w, _ in got.values() if w)
    assert bad == ["missing passage fields: page", "missing: ext", *["not a document record"] * 4, "unknown passage fields: color"]
    assert len(got) == 17 and sum(w is None for w, _ in got.values()) == 10
    assert store.repair()
    again = said()
    assert all(r in (None, []) for _, r in again.values()) and sorted(str(w) for w, _ in again.values()) == sorted(str(w) for w, _ in got.values())
    assert not store.repair()
    fixed = {r["doc_id"]: r for r in store.load().where("warning is null").collect()}
    assert fixed["d1"]["term_counts"] == record(1)["term_counts"] and fixed["d2"]["doc_lengths"] == [3, 4] and fixed["d3"]["vectors"][0] == {"gene": 2.0, "assay": 1.0}
    assert all(x["chunk_type"] in ("body", "caption", "figure_derived") for x in fixed["d4"]["passages"])
    assert fixed["d5"]["doc_type"] == "variant" == fixed["d5"]["passages"][1]["doc_type"] and fixed["d6"]["passages"][1]["doc_type"] == "paper"


# ---- report graphs


def test_reports_become_graphs_and_back(spark):
    cite = {"doc_id": "d", "source_path": "p", "chunk_id": 3, "page": None, "odd": 1}
    report = {
        "title": "T", "query": None, "coverage": {"total_passages": 1, "figure_passages": 0, "metric_candidates": 0}, "audit": {"render_status": "supported", "dropped_claim_ids": ["c9"]}, "other": {"deep": [1]},
        "supported_claims": [{"id": "c1", "statement": "s", "support_status": "supported", "citations": [cite, cite | {"chunk_id": 4}], "related_metrics": ["m1"]}, {"id": "c2", "statement": "t"}],
        "limitations": [{"id": "l1", "kind": "scope", "description": "few", "citations": [cite]}], "metric_summaries": [{"id": "m1", "metric_label": "auc", "value": "0.9", "dataset": "x", "citation": cite}],
        "conflicts": [{"id": "x1", "description": "differ", "status": "conflicting_evidence", "citation_refs": [cite], "related_claim_ids": ["c1", "c2"]}], "unsupported_claims": [{"id": "u1", "topic": "why", "status": "insufficient_evidence"}],
        "retrieval_candidates": [{"doc_id": "d", "source_path": "p", "chunk_id": 3, "kept": False}, {"doc_id": "e", "source_path": "p", "chunk_id": 0}],
    }
    texts = [json.dumps(report), "{", json.dumps({"title": "T"}), json.dumps(report | {"conflicts": [{"description": "no id"}]}), json.dumps({k: report[k] for k in ("title", "coverage", "audit")}), None]
    r = reports.read_reports(spark.createDataFrame(list(enumerate(texts)), "n int, value string"))
    assert [x["warning"] for x in r.orderBy("n").collect()] == [None, "not a report", "missing: coverage, audit", "no id in: conflicts", None, "not a report"]
    assert rows(reports.nodes(r, "n").where("n = 0").select("kind", "id")) == [("claim", "c1"), ("claim", "c2"), ("conflict", "x1"), ("limitation", "l1"), ("metric", "m1"), ("passage", "d#3"), ("passage", "d#4"), ("passage", "e#0"), ("report", "report"), ("unsupported", "u1")]
    assert rows(reports.edges(r, "n").where("n = 0").select("source", "relation", "target")) == sorted(
        [("report", "holds", i) for i in ("c1", "c2", "u1", "l1", "m1", "x1")] + [("c1", "cites", "d#3"), ("c1", "cites", "d#4"), ("l1", "cites", "d#3"), ("x1", "cites", "d#3"), ("m1", "cites", "d#3")]
        + [("c1", "uses", "m1"), ("x1", "about", "c1"), ("x1", "about", "c2"), ("report", "left out", "d#3"), ("report", "kept", "e#0"), ("report", "dropped", "c9")], key=str
    )
    assert rows(reports.nodes(r, "n").where("n = 4").select("kind", "id")) == [("report", "report")]
    fields = [c for c in r.columns if c not in ("n", "warning")]
    again = reports.read_reports(r.where("n = 0").select("n", F.to_json(F.struct(*fields)).alias("value")))
    assert again.drop("warning").collect() == r.where("n = 0").drop("warning").collect()


# ---- rules


def test_benchmark_files_and_the_gate_to_scoring(spark, tmp_path):
    item = dict.fromkeys(rules.ITEM_FIELDS, "x") | {"id": " a ", "benchmark_track": rules.TRACKS[0], "expected_audit_state": "supported", "task_type": "TODO choose", "verification_status": "human_verified"}
    items = [item, item | {"id": "b", "benchmark_track": "TODO"}, item | {"id": "a", "task_type": "chat"}, {k: v for k, v in item.items() if k != "notes"} | {"id": "c", "verification_status": " needs_human_review", "gold_answer": " todo"}]
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"items": items, "benchmark_name": "n"}))
    found, bad = rules.read_benchmark(spark, str(path))
    assert found.count() == 4
    assert rows(bad) == sorted([("b", "benchmark_track", "one_of", "TODO"), ("a", "task_type", "one_of_or_todo", "chat"), ("c", "notes", "present", None), ("a", "id", "unique", "a"), ("a", "id", "unique", "a")], key=str)
    with pytest.raises(rules.Refused, match="one_of"):
        rules.refuse(bad.where("key = 'b'"), "benchmark")
    assert rows(rules.scoring_ready(found).where("key = 'c'").select("field", "rule")) == [("gold_answer", "done"), ("verification_status", "one_of")]
    assert rows(rules.scoring_ready(found.limit(0)).select("key", "field")) == [("benchmark", "items")]
    path.write_text('{"items": 3}')
    with pytest.raises(rules.Refused):
        rules.read_benchmark(spark, str(path))
    own, bad = rules.manifest_papers(spark.createDataFrame([("s", "T", None, None), ("", "T", None, "u"), ("r", "T", "other", " u "), (None, None, None, None)], "slug string, title string, benchmark_track string, source_url string"))
    assert rows(own) == [("r", "T", "other", "u"), ("s", "T", rules.TRACKS[0], "")] and rows(bad.select("key", "value")) == [("r", "other")]


# ---- marks


def marked_by_loops(text, query):
    low, found = query.lower(), []
    if any(w in low for w in H.NUMBER_WORDS):
        found += [m.span() for m in re.finditer(r"\d+(?:\.\d+)?%?", text)]
    for p in (r"\bpathogenic(?:ity)?\b", r"\bbenign\b", r"\bVUS\b", r"\bClinVar\b", r"\bPLL?R\b", r"\bKL divergence\b"):
        found += [m.span() for m in re.finditer(p, text, re.IGNORECASE)]
    for t in dict.fromkeys(x for x in re.findall(r"[a-z0-9][a-z0-9._+/-]*", low) if len(x) >= 3 or x.isdigit()):
        found += [m.span() for m in re.finditer(re.escape(t), text, re.IGNORECASE)]
    cover = [False] * len(text)
    joined = set()
    for a, b in found:
        cover[a:b] = [True] * (b - a)
        joined |= set(range(a, b - 1))
    out, inside, ends = "", False, {b for _, b in found}
    spans = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    at = 0
    for a, b in spans:
        out, at = out + text[at:a] + "**" + text[a:b] + "**", b
    return len(found), out + text[at:]


def test_marks_as_by_loops(spark):
    rng = random.Random(2)
    words = ["gene", "Gene", "a.b", "AUC", "0.93", "95%", "benign", "VUS", "vuss", "PLLR", "kl divergence", "é", "12", "genes", "(x)", "gegege", "\n"]
    cases = [("".join(rng.choice(words) + rng.choice([" ", "", " "]) for _ in range(rng.randint(0, 25))), " ".join(rng.choice(["gene", "auc", "a.b", "12", "ge", "gege", "benign", "what", "7"]) for _ in range(rng.randint(0, 4)))) for _ in range(150)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, query string").withColumn("spans", H.spans(F.col("text"), F.col("query")))
    got = df.select("i", F.size("spans").alias("n"), H.marked(F.col("text"), F.col("spans")).alias("m")).orderBy("i").collect()
    assert [(r["n"], r["m"]) for r in got] == [marked_by_loops(*c) for c in cases]
    assert any("**" in r["m"] for r in got)


# ---- abbreviations


def test_abbreviation_details(spark):
    passages = [(d, c, "paper" if d % 3 else "variant", f" context {d}.{c} " + "z" * 300, ["dna", "dna"] if c == 0 else ["vus"] if d < 2 else []) for d in range(14) for c in range(2)]
    passages.append((20, 0, "paper", None, ["abc"]))
    out = {r["token"]: r for r in E.abbreviation_details(spark.createDataFrame(passages, "doc_id int, chunk_id int, mode string, context string, short_tokens array<string>")).collect()}
    assert set(out) == {"dna", "vus"}
    dna = out["dna"]
    assert dna["frequency"] == 28 and [(x["doc_id"], x["n"]) for x in dna["documents"]] == [(d, 2) for d in range(10)]
    assert dna["modes"] == {"paper": 18, "variant": 10} and [(x["doc_id"], x["chunk_id"]) for x in dna["contexts"]] == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0)]
    assert dna["contexts"][0]["context"].startswith("context 0.0 zz") and len(dna["contexts"][0]["context"]) == 200
    assert dna["confidence"] == round(min(1.0, 0.3 + 0.5 * 18 / 28 + 0.02 * 25), 3) and dna["review"] is True and out["vus"]["review"] is False
    assert out["vus"]["long_form"] == "variant of uncertain significance"
