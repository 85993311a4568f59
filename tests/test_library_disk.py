"""The stored library is compressed, made without shuffling texts, and its older version can go once it is repaired."""

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from lodestone.plans import library_queries as Q
from lodestone.sources import repair
from lodestone.sources import tables as S


def documents(path, ids=range(60)):
    texts = [" ".join(f"word{(i * j) % 17} of it" for j in range(30 + i)) + "." * (i % 10) for i, _ in enumerate(ids)]
    pd.DataFrame({"doc_id": list(ids), "text": texts, "lang": "en"}).to_parquet(path / "documents.parquet", index=False)
    return texts


def test_a_repaired_library_takes_little_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "folder", lambda _: f"file://{tmp_path}/own")
    texts = documents(tmp_path)
    got = {r["state"]: r["n"] for r in Q.library_repaired(spark, str(tmp_path)).collect()}
    assert got == {"sound": sum(len(t) % 10 > 1 for t in texts), "missing: source_path": sum(len(t) % 10 == 1 for t in texts), "not a document record": sum(len(t) % 10 == 0 for t in texts)}
    stored = sum(p.stat().st_size for p in (tmp_path / "own").rglob("part-*"))
    assert stored < sum(map(len, texts))  # plain lines in two versions took some nine times the texts
    assert len(list((tmp_path / "own").glob("records-*/lines-*"))) == 1


def test_the_library_is_made_without_a_shuffle_of_texts(spark, tmp_path):
    documents(tmp_path)
    d = Q._with_passages(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text"))
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_id_share_their_passages(spark):
    rows = [(1, "alpha beta beta"), (2, "gamma"), (1, "delta"), (None, "eps one"), (None, "eps two"), (3, None)]
    d = Q._with_passages(spark.createDataFrame(rows, "doc_id int, text string"))
    got = sorted(((r["doc_id"], sorted(p["text"] for p in r["p"]), [(p["n"], {c["term"]: c["tf"] for c in p["c"]}) for p in r["p"]]) for r in d.collect()), key=str)
    one = (1, ["alpha beta beta", "delta"], [(3, {"alpha": 1, "beta": 2}), (1, {"delta": 1})])
    assert got == sorted([one, one, (2, ["gamma"], [(1, {"gamma": 1})]), (None, ["eps one"], [(2, {"eps": 1, "one": 1})]), (None, ["eps two"], [(2, {"eps": 1, "two": 1})]), (3, [], [])], key=str)


def test_lines_that_need_no_repair_stay_and_older_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "MOST_LINES", 2)
    store = repair.LibraryStore(spark, f"file://{tmp_path}/s")
    sound = {"doc_id": "a", "source_path": "p.txt", "ext": "txt", "passages": [], "vectors": [], "term_counts": [], "doc_lengths": [], "of its own": 1}
    lines = [json.dumps(sound), json.dumps(sound | {"doc_id": "b", "vectors": None}), "{", "null", "  ", json.dumps(sound | {"doc_id": "c"})]
    store.save(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    assert len(list(Path(tmp_path / "s").glob("lines-*/*.gz"))) == 3 and store.load().count() == 5
    assert store.repair()
    store.vacuum(1)
    assert len(list(Path(tmp_path / "s").glob("lines-*"))) == 1 and len(store.log.numbers()) == 1 and not store.repair()
    values = {r["value"] for r in store.load().collect()}
    assert {lines[0], lines[2], lines[3], lines[5]} < values and len(values) == 5
    assert store.load().where(F.col("warning").isNull() & (F.size("repairs") > 0)).count() == 0
