"""Min-max near-dedup against components of all pairs by sets of words, and the signature's estimates."""

import itertools
import random
import re

import numpy as np

from lodestone.llm import jaccard_join, minmax_dedup

SCHEMA = "doc_id long, text string, n_shingles int, kept string, component_id string"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def by_pairs(rows, k, percent):
    own = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(own[i] & own[j])
        if own[i] and own[j] and 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
            root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if own[i] else key
        out.append((key, len(own[i]), least, key == least))
    return sorted(out, key=str)


def deduped(spark, rows, **more):
    df = minmax_dedup.dedup(spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA), **more)
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    return sorted(map(tuple, df.collect()), key=str)


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed, n=160):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(rng.choice([4, 30, 60, 200, 400]))]
        texts += [near(rng, words, rng.choice([0, 0, 1, 2, 3, 6])) for _ in range(n // 12)]
        texts += [" ".join(words[: len(words) // 2]), " ".join(words) + " and a tail of words that no other text has got"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_as_of_all_pairs(spark):
    rows = corpus(1)
    want = by_pairs(rows, 5, 85)
    assert len({r[2] for r in want}) < len(want) - 40
    assert deduped(spark, rows) == want


def test_large_families_are_dealt_into_blocks(spark):
    rows = corpus(2)
    assert deduped(spark, rows, most=300) == by_pairs(rows, 5, 85)


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "a", "A", "a b", LONG, LONG + " end", LONG, "one two three four five", "one two three four FIVE", "é ü", "É ü", "x" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (None, "none like it here at all"), (None, None), (6, LONG), (3, "a"), (13, "no copy of the other row with this id")]
    assert deduped(spark, rows) == by_pairs(rows, 5, 85)
    assert deduped(spark, []) == []


def test_a_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(20)]
    got = deduped(spark, rows, percent=90)
    assert got == by_pairs(rows, 5, 90) and {r[2] for r in got} == {0}


def test_names_beyond_the_bound_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "MOST_NAMES", 3)
    rows = corpus(3, 60)
    assert deduped(spark, rows) == by_pairs(rows, 5, 85)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(4)
    off = []
    for share in (0.3, 0.5, 0.85, 0.95):
        for _ in range(20):
            a = rng.integers(0, 2**63, 400, dtype=np.uint64)
            b = a.copy()
            b[: round(400 * (1 - share) / (1 + share))] = rng.integers(0, 2**63, round(400 * (1 - share) / (1 + share)), dtype=np.uint64)
            same = len(np.intersect1d(a, b))
            values = minmax_dedup.signatures(np.concatenate([a, b]), np.array([400, 400]))
            assert (values[:160] < values[160:]).all()
            off.append(minmax_dedup.similarity(values[:, 0], values[:, 1]) - same / (800 - same))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.035


def test_bands_find_nearly_every_pair_at_the_threshold():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 370, dtype=np.uint64)
        b = a.copy()
        b[:30] = rng.integers(0, 2**63, 30, dtype=np.uint64)
        keys = minmax_dedup.bands(minmax_dedup.signatures(np.concatenate([a, b]), np.array([370, 370])))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0 and jaccard_join.linked(340, 370, 370, 85)
