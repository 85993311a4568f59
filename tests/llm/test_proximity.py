"""Proximity matches of items of several words, against plain loops."""

import math
import random

from lodestone.llm import decontam


def slow(words, item, slop, share):
    need, best = max(2, math.ceil(len(item) * share)), None
    for p, w in enumerate(words):
        for o, t in enumerate(item):
            if t == w:
                gaps = [min((abs(i - (p - o + k)) for i, x in enumerate(words) if x == u and abs(i - (p - o + k)) <= slop), default=None) for k, u in enumerate(item)]
                gaps = [g for g in gaps if g is not None]
                if len(gaps) >= need:
                    best = min(best or (1, 0), (-len(gaps), max(gaps)))
    return best and (-best[0], best[1])


def test_a_changed_unseen_word_is_no_escape(spark):
    docs = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon end"), (2, "alpha far off gamma and epsilon"), (3, "alpha x beta gamma delta epsilon")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma delta zzz epsilon")], "item_id string, text string")
    out = {r.doc_id: (r.matched, r.distance) for r in decontam.proximity(docs, items, slop=1).collect()}
    assert out == {1: (5, 1), 3: (5, 1)}


def test_proximity_matches_loops(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(4, 9))]) for i in range(6)]
    docs = []
    for d in range(24):
        words = [rng.choice(vocabulary) for _ in range(20)]
        own = list(items[d % 6][1])
        own[rng.randrange(len(own))] = "unseen"
        if rng.random() < 0.5:
            own.insert(rng.randrange(len(own)), "more")
        docs.append((d, words[:9] + own + words[9:]))
    items.append((6, ["never", "w1", "w2", "w3", "w4", "w5"]))
    want = {(d, str(i)): found for d, words in docs for i, item in items if (found := slow(words, item, 1, 0.6))}
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    out = decontam.proximity(frame(docs, "doc_id"), frame(items, "item_id"), slop=1, share=0.6).collect()
    assert len(want) > 10
    assert {(r.doc_id, r["item"]): (r.matched, r.distance) for r in out} == want
