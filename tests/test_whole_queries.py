"""Queries over all pairs of a table, against plain loops on the smallest tables."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.operators import evidence as S
from lodestone.operators import retrieval as R
from lodestone.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_seeds_come_from_all_documents(spark, table):
    cut = lambda t: list(dict.fromkeys(w for w in re.sub(r"[^a-z0-9_+\-./ ]+", " ", t.lower()).split(" ") if len(w) >= 2))
    share = lambda terms, low: sum(t in low for t in terms) / len(terms)
    want, residues = set(), set()
    docs = [(r.doc_id, (r.text or "").lower()) for r in table("documents")]
    for b in table("benchmark"):
        terms = cut(b.text)
        info = [t for t in terms if t not in [*V.QUERY_STOPWORDS, *V.MODE_KEYWORDS.get("paper", [])] and (len(t) >= 5 or t in V.SHORT_TOKENS)]
        scored = []
        for doc, low in docs:
            over = share(terms, low)
            if over >= 0.2:
                scored.append((-round(0.7 * over + 0.3 * (share(info, low) if info else over), 6), doc))
        for score, doc in sorted(scored)[:2]:
            want.add((b.item_id, doc, -score))
            residues.add(doc % 40 == b.item_id % 40)
    got = {(r.query_id, r.doc_id, r.score) for r in plans.QUERIES["target_seed"](spark, SF).collect()}
    assert got == want and False in residues  # the best documents are not those of the query's own residue


def test_every_fiftieth_vector_is_searched(spark, table):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table("embeddings")]
    want = set()
    for query, a in rows:
        if query % 50 == 0:
            scored = []
            for i, b in rows:
                total = 0.0
                for x, y in zip(a, b):
                    total += x * y
                scored.append((-round(total, 6), i))
            want |= {(query, i, -s, n) for n, (s, i) in enumerate(sorted(scored)[:10], 1)}
    assert {tuple(r) for r in plans.QUERIES["dense_batch"](spark, SF).collect()} == want
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    blocks = R.dense_top(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10, rows=70, block=3)
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in blocks.collect()} == want


def test_variants_are_read_from_every_part(spark, table):
    parts, kinds = table("part"), list(V.CLINVAR)
    said = {}
    for r in parts:
        kind = kinds[zlib.crc32(r.p_type.encode()) % len(kinds)]
        said.setdefault(f"c.{r.p_size}a>t", set()).add(V.CLINVAR[kind])
    fields = {r.doc_id: r for r in plans.QUERIES["variant_fields"](spark, SF).collect()}
    assert len(fields) == len(parts)
    for r in parts:
        f = fields[r.p_partkey]
        assert (f.variant_id, f.gene, f.case_count, f.ancestry) == (f"c.{r.p_size}A>T", "GENE" + re.search(r"\d+", r.p_brand)[0], r.p_size + 1, "European ancestry")
        assert f.clinvar == V.CLINVAR[kinds[zlib.crc32(r.p_type.encode()) % len(kinds)]] and f.gnomad == f"0.{r.p_partkey % 90 + 10}"
    got = {(r.variant, r.labels) for r in S.variant_conflicts(S.variant_fields(plans._variant_text(spark, SF))).collect()}
    assert got == {(v, ", ".join(sorted(x))) for v, x in said.items() if len(x) > 1} and got
    assert sum(r.total_passages for r in plans.QUERIES["variant_coverage"](spark, SF).collect()) == len(parts)
