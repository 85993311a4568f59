"""Ranked search against scores by loops over all documents, the bisection's cost, and that clusters are passed over."""

import math
import random
import re
from collections import Counter

import numpy as np

from lodestone.llm import ranked_search

DOCS, ITEMS = "doc_id long, text string, score string, rank int, leaf int", "item_id string, text string, q long, id int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_loops(docs, items, k=20):
    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in own:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    df = ranked_search.search(spark.createDataFrame([(*d, "", 0, 0) for d in docs], DOCS), spark.createDataFrame([(*i, 0, 0) for i in items], ITEMS), **more)
    assert [t for _, t in df.dtypes] == ["string", "int", "bigint", "bigint"]
    return sorted(map(tuple, df.collect()), key=str)


def corpus(seed, n=700):
    rng = random.Random(seed)
    topics = [[f"t{i}w{j}" for j in range(40)] for i in range(8)]
    docs = []
    for i in range(n):
        topic = rng.choice(topics)
        docs.append((i, " ".join(rng.choice(topic if rng.random() < 0.7 else ["the", "of", "And", "a-b", "é"]) for _ in range(rng.choice([1, 5, 30, 80])))))
    docs += [(n + i, docs[3][1]) for i in range(40)]  # ties
    items = [(str(i), " ".join(rng.choice(rng.choice(topics[i % 8 : i % 8 + 1] * 5 + [["the", "of", "nowhere"]])) for _ in range(12))) for i in range(14)]
    rng.shuffle(docs)
    return docs, items


def test_results_as_by_loops(spark):
    docs, items = corpus(1)
    want = by_loops(docs, items)
    assert len(want) == 14 * 20
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, k=3) == by_loops(docs, items, 3)


def test_many_small_clusters_shards_and_blocks(spark, monkeypatch):
    docs, items = corpus(2, 400)
    for name, value in (("LEAF_SAMPLE", 8), ("SHARD", 5), ("BLOCK_ITEMS", 6), ("SAMPLE", 200)):
        monkeypatch.setattr(ranked_search, name, value)
    assert searched(spark, docs, items) == by_loops(docs, items)


def test_edge_cases(spark):
    texts = [None, "", " .,! ", "word", "Word word", "word " * 30_000, "a b c", "a b c", "É é", "x" * 5000, "\x7fa\x00b"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c word"), (None, "c"), (6, "a b c")]
    items = [("1", "word WORD a"), ("1", "b"), (None, "c c é"), ("e", ""), ("n", None), ("z", "not there"), ("1", "word word a")]
    assert searched(spark, docs, items) == by_loops(docs, items)
    assert searched(spark, [], items) == searched(spark, docs, []) == searched(spark, [(1, "")], items) == []


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(3)
    groups = rng.permutation(np.repeat(np.arange(4), 64))
    docs = [np.unique(np.concatenate([g * 20 + rng.integers(0, 20, 8), 80 + rng.integers(0, 5, 3)])) for g in groups]
    flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    leaf = ranked_search.leaves(flat, sizes, ranked_search.bisection(flat, sizes, 85, 2))
    pure = sum(np.bincount(groups[leaf == i]).max() for i in range(4) if (leaf == i).any())
    assert pure >= 0.95 * len(groups) and len(set(leaf)) == 4


def test_clusters_below_the_threshold_are_not_read(spark, monkeypatch):
    docs, items = corpus(4, 900)
    monkeypatch.setattr(ranked_search, "LEAF_SAMPLE", 30)
    read, visit = [], ranked_search.visit
    monkeypatch.setattr(ranked_search, "visit", lambda idx, queries, size, wanted, *a: read.append(wanted.sum()) or visit(idx, queries, size, wanted, *a))
    items = [(i, t) for i, t in items if "the" not in t.split() and "of" not in t.split()]
    assert searched(spark, docs, items, k=5) == by_loops(docs, items, 5)
    assert sum(read) < 0.7 * len(items) * 16


def test_best_places_takes_the_first_of_equal_scores():
    scores = np.array([5, 7, 5, 5, 0, 9, 5])
    assert sorted(ranked_search.best_places(scores, 1, 4).tolist()) == [0, 1, 2, 5]
    assert sorted(ranked_search.best_places(scores, 6, 4).tolist()) == [1, 5]
