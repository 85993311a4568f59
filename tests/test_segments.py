"""The growing index against one built whole: additions, replacements, withdrawals, versions, conflicts and the inbox."""

import pytest

from lodestone.operators import retrieval as R
from lodestone.sources.segments import SearchIndex
from lodestone.sources.versions import Conflict, Log, StateTable
from lodestone.streaming import inbox

SCHEMA = "doc_id string, text string"
DOCS = {f"d{i}": f"gene assay number{i % 7} " + "alpha beta " * (i % 4) + ("\n\nsecond part on yeast" if i % 3 else "") for i in range(30)}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), SCHEMA)


def same(spark, index, rows):
    """Whether all that searches read, and their results, are those of an index built at once."""
    whole, grown = R.Library(R.passages(frame(spark, rows))), index.library()
    asked = spark.createDataFrame([("a", "gene alpha number3"), ("b", "yeast assay beta beta"), ("c", "changed words")], "query_id string, query string")
    tables = lambda lib: [lib.df, lib.stats, lib.passages, lib.idf, R.search(asked, lib, "bm25"), R.search(asked, lib, "tfidf")]
    for a, b in zip(tables(whole), tables(grown)):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)
    return True


def test_grows_like_one_built_whole(spark, tmp_path):
    index, rows = SearchIndex(spark, f"file://{tmp_path}/i"), {}
    with pytest.raises(LookupError):
        index.library()
    for part in (dict(list(DOCS.items())[:20]), dict(list(DOCS.items())[20:])):
        index.add(frame(spark, part))
        rows |= part
    assert same(spark, index, rows)
    change = {"d3": "changed words", "d9": "", "new": "gene yeast", "d4": DOCS["d4"]}
    index.add(frame(spark, change))
    rows |= change
    assert same(spark, index, rows)
    index.remove(spark.createDataFrame([("d5",), ("d5",), ("nowhere",), ("new",)], "doc_id string"))
    del rows["d5"], rows["new"]
    assert same(spark, index, rows)
    index.settle()
    assert same(spark, index, rows)
    before = index.version()
    index.compact()
    assert same(spark, index, rows) and index.version() == before + 1
    index.vacuum()
    assert same(spark, index, rows) and index.log.numbers() == [before + 1]


def test_no_old_text_is_read(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    index.add(frame(spark, DOCS))
    name = index.log.latest()[1]["segments"][0]["name"]
    index.log.remove(f"{name}/passages")
    index.add(frame(spark, {"d1": "gene", "x": "more"}))
    index.remove(spark.createDataFrame([("d2",)], "doc_id string"))
    rows = {k: v for k, v in DOCS.items() if k != "d2"} | {"d1": "gene", "x": "more"}
    whole = R.Library(R.passages(frame(spark, rows)))
    said = index.log.latest()[1]
    assert sorted(index.frequencies(said["segments"]).collect()) == sorted(whole.df.collect())
    assert said["sums"]["total_passages"] == whole.stats.first()["total_passages"]


def test_readers_keep_their_version_and_empty_changes_commit_nothing(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    first = index.add(frame(spark, {"a": "one two"}))
    assert index.add(frame(spark, {})) == first == index.remove(spark.createDataFrame([("z",)], "doc_id string"))
    index.add(frame(spark, {"a": "three"}))
    assert [r["term"] for r in index.library(first).df.orderBy("term").collect()] == ["one", "two"]
    assert [r["term"] for r in index.library().df.collect()] == ["three"]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/l")
    assert log.latest() == (-1, {})
    assert log.commit(-1, {"x": 1}) == 0
    with pytest.raises(Conflict):
        log.commit(-1, {"x": 2})
    assert log.latest() == (0, {"x": 1})
    (tmp_path / "l/_log/000000000001.json").write_text("{broken")
    assert log.latest() == (0, {"x": 1}) and log.commit(0, {"x": 3}) == 2


def test_state_table_saves_replaces_deletes_and_survives_bad_files(spark, tmp_path):
    table = StateTable(spark, f"file://{tmp_path}/t", ["name"], "name string, note string")
    made = lambda *rows: spark.createDataFrame(list(rows), "name string, note string")
    have = lambda: sorted(map(tuple, table.load().collect()), key=str)
    assert have() == []
    table.save(made(("a", "1"), ("b", "2"), (None, "3")))
    table.save(made(("b", "4"), ("c", "5"), (None, "6")))
    assert have() == [("a", "1"), ("b", "4"), ("c", "5"), (None, "6")]
    table.delete(spark.createDataFrame([("a",), ("z",)], "name string"))
    assert have() == [("b", "4"), ("c", "5"), (None, "6")]
    table.vacuum(keep=1)
    assert len(table.log.numbers()) == 1 and len(have()) == 3
    for f in (tmp_path / "t/_log").glob("*.json"):
        f.write_text("no json")
    assert have() == []
    table.save(made(("n", "7")))
    assert have() == [("n", "7")]


def test_the_inbox_adds_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    index, at = SearchIndex(spark, f"file://{tmp_path}/i"), (f"{tmp_path}/in", f"{tmp_path}/c")
    run = lambda: inbox.sync_index(spark, at[0], index, at[1]).awaitTermination()
    (tmp_path / "in/a.txt").write_text("alpha gene")
    run()
    (tmp_path / "in/b.md").write_text("beta gene")
    run()
    run()
    assert {r["term"]: r["df"] for r in index.library().df.collect()} == {"alpha": 1, "beta": 1, "gene": 2}
    for name in ("1", ".1.crc"):
        (tmp_path / "c/commits" / name).unlink(missing_ok=True)
    run()
    assert index.log.latest()[1]["sums"]["total_docs"] == 2 and index.log.latest()[1]["marks"] == {at[1]: 1}
