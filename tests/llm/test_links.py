"""Numbers of links of the similarity join, against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join
from lodestone.llm.common import dealt


def shingle_set(text, k):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k,percent,most", [(3, 80, 500_000), (3, 80, 400), (2, 60, 150)])
def test_links_within_large_families_are_counted(spark, k, percent, most):
    rng = random.Random(percent + most)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = [None, "", " \n", "a", "A", "other words entirely here"]
    for size, copies in ((40, 30), (60, 25), (12, 8), (5, 4)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(size)] = word()
            texts += [" ".join(own)] * rng.choice([1, 1, 3])
    sets = [shingle_set(t, k) for t in texts]
    want = {i: sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = jaccard_join.join(docs, k=k, percent=percent, most=most, links=True)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert {r.doc_id: r.n_links for r in out.collect()} == want
    plain = jaccard_join.join(docs, k=k, percent=percent, most=most)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, out.drop("n_links").collect()))


def test_more_shards_than_partitions_change_nothing(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(12)]
    rows = [(i, " ".join([*base[i % 12].split()[: 60 - i // 40], "z"])) for i in range(120)] + [(200, None), (201, ""), (None, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = jaccard_join.join(docs, k=3, percent=90).collect()
    many = jaccard_join.join(docs, k=3, percent=90, shard_bytes=500).collect()
    assert sorted(map(str, few)) == sorted(map(str, many)) and len({r.component_id for r in few}) < len(rows)


def test_rows_are_dealt_to_the_partition_of_their_number(spark):
    rows = dealt(spark.range(1000).withColumn("shard", F.col("id") % 37), 37, F.col("shard"))
    assert rows.rdd.getNumPartitions() == 37
    assert rows.where(F.spark_partition_id() != F.col("shard")).count() == 0
