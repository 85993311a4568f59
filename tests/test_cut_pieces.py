"""Pieces of a cut line that are tables, against the query's own SQL."""

import duckdb
import pandas as pd

from lodestone.plans import queries as plans


def test_pieces_of_a_cut_line_are_marked_as_the_sql_marks_them(spark, tmp_path):
    numbers = " ".join(map(str, range(100, 160)))
    texts = ["x" * 1690 + " " + numbers, "Table 4 " + "y" * 1800, "one\n" + "z" * 3500 + "\ntwo", "w" * 1700 + "\nfig. 3 " + "v" * 1700 + numbers[:90], "short", None]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    documents.to_parquet(tmp_path / "documents.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(plans.ORACLE_SQL["chunk_paragraphs"]).fetchall()
    assert sorted(map(tuple, plans.QUERIES["chunk_paragraphs"](spark, str(tmp_path)).collect())) == sorted(want)
