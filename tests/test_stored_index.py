"""The stored index: chunks, counted terms, vectors and searches that read passages whole, against loops and against joins."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import text as X
from lodestone.operators import retrieval as R
from lodestone.operators import vectors as D
from lodestone.plans import queries as plans
from lodestone.sources.tables import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, rows):
    """A library with all parts that an index keeps."""
    t = {"passages": spark.createDataFrame(rows, "doc_id long, chunk_id int, text string")}
    for name, make in R.Library.STORED.items():
        t[name] = written(make(t), f"index-{name}")
    return R.Library(t["passages"], t)


def test_chunks_carry_no_document_along_and_see_unicode_blanks(spark):
    rng = random.Random(3)
    parts = ["one ", " two", "Table 3 of it", "a|b\nc|d\ne|f", " ".join(map(str, range(30))), "x" * 700, " ", "y" * 1900, "FIG. 7 İ", "\x1c"]
    texts = [(i, "\n \n".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (60, None), (61, " \n")], "doc_id long, text string")
    got = R.passages(docs)
    assert "Generate" not in plan(got)  # a chunk's row was made with all chunks of its document beside it
    rows = [(r.doc_id, r.chunk_id, r.text) for r in got.collect()]
    assert {d for d, _, _ in rows} <= set(range(60)) and len(rows) > 100
    t = F.col("text")
    marked = spark.createDataFrame([(w,) for w in {"\n\n".join(x) for x in zip(parts, parts[1:])} | set(parts)], "text string").select("text", C.is_table_or_figure(t).alias("is"), X.strip(t).alias("s")).collect()
    assert all(R._is_table(r.text) == r["is"] and r.text.strip(R._BLANK) == r.s for r in marked) and {r["is"] for r in marked} == {True, False}


def test_terms_are_counted_as_the_columns_count_them(spark):
    odd = ["", " ", "İstanbul KK k", "a-b a-b c.d x", "Straße Äpfel 12,5 ab\nab", "zz " * 300]
    p = spark.createDataFrame([(i, 0, t) for i, t in enumerate(odd)] + [(9, 0, None)], "doc_id long, chunk_id int, text string")
    got = {r.doc_id: r for r in R._counted({"passages": p}).collect()}
    for r in p.select("doc_id", R.counted(X.tokenize(F.col("text"))).alias("t"), F.coalesce(F.size(X.tokenize(F.col("text"))), F.lit(0)).alias("n")).collect():
        assert got[r.doc_id].t == (r.t or []) and got[r.doc_id].length == max(0, r.n) and got[r.doc_id].most == max((x.tf for x in r.t or []), default=None)


def test_searches_of_stored_lists_shuffle_no_pairs_and_agree_with_joins(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    rows = [(i * 60 + j, c, t) for i in range(5) for j, t in enumerate(texts) for c in (0, 1)]  # copies: many equal scores
    lib = stored(spark, rows)
    q = spark.createDataFrame([(i, " ".join(rng.choice([*words, "unknown"]) for _ in range(i % 7))) for i in range(20)], "query_id long, query string")
    for method in ("bm25", "tfidf"):
        for k in (1, 7, 1000):
            got = R.search(q, lib, method, k)
            assert "SortMergeJoin" not in plan(got) and plan(got).count("HashAggregate") == 0
            want = R.top(R.BACKENDS[method](q, lib), k, ["doc_id", "chunk_id"])
            key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.chunk_id, r.score) for r in df.collect())
            assert key(got) == key(want) and got.count() > 0
    some = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    assert {r.doc_id % 3 for r in R.search(q, lib.restricted(some), "bm25", 5).collect()} == {0}


def test_scores_are_rounded_as_spark_rounds(spark):
    import numpy as np

    rng = random.Random(1)
    raw = [rng.random() * 50 for _ in range(500)] + [i / 1e6 + 5e-7 for i in range(500)] + [0.0, 1e-7, 5e-7]
    want = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("s")).collect()]
    assert list(R._rounded(np.array(raw))) == want


def test_vectors_of_hashed_words(spark):
    text = "Alpha beta, beta x 12 İ"
    v = [0.0] * 64
    for w in ("alpha", "beta", "beta", "12"):
        v[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64] += 1
    n = math.sqrt(sum(x * x for x in v))
    got = spark.createDataFrame([(1, text), (2, "x !"), (3, None)], "i int, t string").select("i", D.hashed(F.col("t")).alias("e"))
    assert "ArrowEvalPython" in plan(got)
    assert {r.i: r.e for r in got.collect()} == {1: [x / n for x in v], 2: None, 3: None}


def test_the_index_keeps_lists_with_their_passages(spark):
    lib = plans._library(spark, "/root/testdata/sf0.001")
    assert lib.weighed is not None and "Exchange" not in re.sub("BroadcastExchange", "", plan(lib.weighed)) and lib.weighed.count() == lib.passages.count()


def test_titles_that_begin_alike_meet_their_own_queries_only(spark):
    docs = spark.createDataFrame([(i, f"Report x{i} of the series", [f"ab{i:02d}"]) for i in range(10, 60)], "doc_id long, title string, aliases array<string>")
    asked = [(i, f"What says Report x{i} of the series? {'See ab%d.' % (i + 1) if i % 2 else ''}") for i in range(10, 30)] + [(90, "ab12"), (91, "ab"), (92, None)]
    q = spark.createDataFrame(asked, "query_id long, query string")
    got = {(r.query_id, r.doc_id, r.strength) for r in R.infer_targets(q, docs).collect()}
    assert got == {(i, i, "strong") for i in range(10, 30)} | {(90, 12, "weak")}
    names = docs.select("doc_id", X.key(F.col("title")).alias("alias"), F.lit(2).alias("s"))
    assert R._meet(q.select("query_id", X.key(F.col("query")).alias("text")), names).count() == 20  # 20 * 50 on four letters
