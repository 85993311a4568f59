"""Small fixtures with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.llm import ann_forest, components, decontam, eflm, fst_tokens, html_extract, jaccard_join, langid, packing, toxicity, url_templates

TOKENIZER = fst_tokens.resolve("byte_bpe_50k.json")
LONG = "word " * 40_000
HARD = [None, "", "  \n\t ", "a", "A b", LONG, "it's we'll <|endoftext|> 'S", " x y", "x" * 5000, "same text here", "same text here"]


def documents(spark, texts=None):
    texts = HARD if texts is None else texts
    rows = [(i if i != 3 else None, t, "en", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens int")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


# ---- token counts and packing


def test_counts_match_the_library():
    rng = random.Random(1)
    parts = ["a", "b", "'", "s", "'ll", "'re", "'ve", " ", "  ", "\n", "\t", "!", "1", "é", "中", " ", "<|endoftext|>", "\U0010ffff", "🙂", "²", " the", ".", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert fst_tokens.counts(texts, TOKENIZER).tolist() == [len(library_ids(t)) for t in texts]


def test_counts_of_long_pretokens_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(s) for _ in range(n)) for s, n in (("abcdefghij", 9000), ("中文字的是不了人", 3000), ("ACGT", 7000), ("0123456789", 500))]
    texts += ["-" * 4099 + "a", " " * 3000, "ab" * 4000, "qwertyzxcv7" * 10 + "abcdefghi" * 400 + "b", "", "\U0010ffff" * 300, "a"]
    want = [len(library_ids(t)) for t in texts]
    for size in (7, 64, 128, 5000):
        monkeypatch.setattr(fst_tokens, "BYTES", size)
        monkeypatch.setattr(fst_tokens, "WARM", min(16, size))
        assert fst_tokens.counts(texts, TOKENIZER).tolist() == want
        assert fst_tokens.counts(texts[::-1], TOKENIZER).tolist() == want[::-1]


def test_transitions_forgotten_between_texts_change_nothing(monkeypatch):
    texts = [t or "" for t in HARD]
    want = fst_tokens.counts(texts, TOKENIZER).tolist()
    monkeypatch.setattr(fst_tokens, "CACHE_STATES", 0)
    assert [int(fst_tokens.counts([t], TOKENIZER)[0]) for t in texts] == want


def test_boundaries_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 9, 5000).astype(np.uint8)
    state, slow = 0, []
    for s in symbols:
        slow.append(bool(fst_tokens._CUT[8 * s + state]))
        state = int(fst_tokens._STEP[8 * s + state])
    for chunk in (3, 64, 256, 10_000):
        monkeypatch.setattr(fst_tokens, "CHUNK", chunk)
        assert fst_tokens.boundaries(symbols).tolist() == slow


def test_token_counts_edge_cases(spark):
    out = fst_tokens.count_tokens(documents(spark), TOKENIZER).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted((len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 1024) for t in HARD)
    assert fst_tokens.count_tokens(documents(spark, []), TOKENIZER).count() == 0


def test_packing_is_a_partition_without_padding(spark):
    pieces = [r.asDict() for r in packing.pack(documents(spark), TOKENIZER, block_tokens=20_000).collect()]
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert sum(p["length"] for p in pieces) == sum(len(library_ids(t)) + 1 for t in HARD)
    for i, t in enumerate(HARD):
        if i == 3:
            continue
        ids = np.array(library_ids(t) + [0], "<u4")
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in own) == ids.tobytes()
        assert all(p["doc_tokens"] == len(ids) and len(p["ids"]) == 4 * p["length"] for p in own)
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        total = sum(p["length"] for p in own)
        assert total <= 1024 and total & (total - 1) == 0
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0


def test_packing_balances_cost():
    lengths = np.array([600, 500, 400, 300, 200, 48])
    rows = packing.place(lengths, 1024)
    assert sum(r[2] for r in rows) == lengths.sum()
    first = {r[0]: r[3] for r in rows if r[1] == 0}
    assert first[0] != first[1] and first[2] == first[1]  # the third goes to the cheaper of the two


# ---- language model


def test_elias_fano_round_trip_and_successor():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        for universe in (1 << 40, 1 << 64, 2000):
            a = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
            e = eflm.EliasFano(*eflm.ef_pack(a, universe))
            assert (e.get(np.arange(n)) == a).all()
            x = rng.integers(0, universe - 1, 50, dtype=np.uint64, endpoint=True)
            low, high = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
            got = e.successor(low, high, x)
            assert got.tolist() == [max(l, min(h, int(np.searchsorted(a, y)))) if l < h else l for l, h, y in zip(low.tolist(), high.tolist(), x)]


def slow_lm(rows, discount=eflm.DISCOUNT):
    count, grams, tokens = collections.Counter(), {2: collections.defaultdict(collections.Counter), 3: collections.defaultdict(collections.Counter)}, []
    for i, text in rows:
        w = [x.lower() if x.isascii() else x for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]
        held = zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
        tokens.append((i, held, w))
        if not held:
            count.update(w)
            path = ["<s>", *w]
            for at, q in enumerate(w):
                grams[2][path[at]][q] += 1
                if at:
                    grams[3][path[at - 1], path[at]][q] += 1
    n, v, once = sum(count.values()), len(count), sum(c == 1 for c in count.values())
    unseen = (once or 1) / (n + 1) if n else 1.0
    alpha, left = {}, {}
    for order, step, most in ((2, eflm.FINE, 65535), (3, eflm.FINE3, 255)):
        for context, own in grams[order].items():
            for q, c in own.items():
                code = min(255, math.ceil(-math.log10((c - discount) / sum(own.values())) / eflm.STEP - 1e-9))
                alpha[context, q] = 0 if code == 255 else 10 ** (-code * eflm.STEP)
            spent = sum(alpha[context, q] for q in own)
            left[context] = 10 ** (-min(most, math.ceil(-math.log10(max(1 - spent, 1e-6)) / step - 1e-9)) * step)
    for i, held, w in tokens:
        path, score = ["<s>", *w], 0.0
        for at, q in enumerate(w):
            p = (1 - unseen) * count[q] / n if count[q] else unseen
            p = alpha.get((path[at], q), 0) + left.get(path[at], 1.0) * p
            if at:
                context = (path[at - 1], path[at])
                p = alpha.get((context, q), 0) + left.get(context, 1.0) * p
            score += math.log10(p)
        yield i, held, len(w), sum(count[q] > 0 for q in w), n, sum(math.log10((count[q] + 1) / (n + v + 1)) for q in w), score


@pytest.mark.parametrize("chunk,shard_bytes", [(50, 100_000), (2_000_000, 12_000_000)])
def test_language_model_matches_brute_force(spark, monkeypatch, chunk, shard_bytes):
    rng = random.Random(5)
    texts = HARD[:5] + HARD[9:] + [" ".join(rng.choice("the a cat dog sat mat on it ran Far".split()) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs = documents(spark, texts)
    docs = docs.union(docs)  # equal partitions
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(eflm, "COMMON", 6)
    out = sorted((tuple(r) for r in eflm.score(docs, shard_bytes=shard_bytes, chunk_tokens=chunk).collect()), key=str)
    want = sorted(slow_lm(rows), key=str)
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6))
    assert sorted(map(key, out)) == sorted(map(key, want))
    assert eflm.score(documents(spark, [])).count() == 0


# ---- classifiers


def test_language_id(spark):
    rng = random.Random(6)
    letters = {"aa": "abcde", "zz": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 6))) for _ in range(60)), k) for i in range(120) for k in [["aa", "zz"][i % 2]]]
    rows += [(1000, None, "aa"), (1001, "12 34!", "aa"), (1002, "", None), (None, "abab cdcd " * 40, None), (1003, "vxyz wxyz " * 30_000, None), (1003, "vxyz wxyz " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predict(docs, langid.train(docs)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    said = {r.doc_id: r for r in out}
    assert [said[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "aa", "zz"] and said[1000].score == 0
    assert all(said[i].lang_pred == k for i, _, k in rows[:120])
    assert said[7].held_out == (zlib.crc32(b"7") % 4 == 2)
    assert {r.lang_pred for r in langid.predict(docs, {"langs": []}).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_network_tables_equal_plain_convolution():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (20, 64)).astype(np.uint8)
    model = langid.fit(x, np.arange(20) % 3, 3, epochs=1)
    pooled = []
    for k in model["filters"]:
        n = x.shape[1] - len(k) + 1
        pooled.append(sum(k[i][x[:, i : i + n]] for i in range(len(k))).max(axis=1))
    h = np.maximum(np.concatenate(pooled, axis=1) + model["bias"], 0)
    assert np.allclose(langid.Network(model).probabilities(x), langid._softmax(h @ model["dense"] + model["offset"]), atol=1e-5)


def test_toxicity(spark):
    rng = random.Random(7)
    clean = "stone river light house green walk table paper cloud music".split()
    bad = ["snarfle", "grumbug"]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(clean) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "Stone " * 30_000 + "SNARFLE"), (None, "green walk"), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    said = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(said[i].predicted == t for i, t in labels)
    assert said[902].predicted == 1 and said[900].predicted == 0 and said[901].score == said[900].score
    none = toxicity.score(docs, toxicity.train(docs, marks.limit(0))).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), marks)).count() == 0


def test_toxicity_scores_match_plain_sums():
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).encode() for _ in range(80)]
    toxic = np.array([b"a" in t.split(b" ")[0] for t in texts])
    model = toxicity.fit(texts, toxic, 0.3, least_z=1.0, rounds=50)
    weight = dict(zip(model["features"].tolist(), model["weights"].tolist()))
    want = []
    for t in texts:  # each n-gram of a word between its borders, once a document
        grams = {g for w in t.split() for g in toxicity.word_features([w])[0].tolist()}
        want.append(sum(weight.get(g, 0.0) for g in grams))
    doc, slot = toxicity.Scorer(model["features"]).documents(texts)
    assert len(weight) > 10 and np.allclose(np.bincount(doc, weights=model["weights"][slot], minlength=len(texts)), want)


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    said = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    bad, good = said[said.toxic == 1], said[said.toxic == 0]
    assert len(bad) > 50 and (bad.predicted == 1).mean() >= 0.8 and (good.predicted == 0).mean() >= 0.98


# ---- similarity join


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in w]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def slow_components(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return sorted(((name, len(s), least.get(find(i)) if s else name) for i, ((name, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("k,percent,most", [(3, 90, 500_000), (5, 80, 500_000), (3, 80, 400)])
def test_jaccard_join_matches_brute_force(spark, k, percent, most):
    rng = random.Random(percent + most)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    shared = [word() for _ in range(40)]
    texts = list(HARD)
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base[1:1] = shared
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    docs = documents(spark, texts)
    out = jaccard_join.join(docs, k=k, percent=percent, most=most).collect()
    assert sorted(map(tuple, out), key=str) == slow_components([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    assert jaccard_join.join(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + rng.randrange(1, 40)) for _ in range(60)] + [(200, 200), (301, 300), (302, 301)]
    got = {(r.u, r.v) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 31)} | {(b, 100) for a, b in edges if a == 100} | {(301, 300), (302, 300)}


# ---- decontamination


def slow_hits(text, items, size):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        x = cut(t)
        for i in range(max(1, len(x) - size + 1)) if x else ():
            part = x[i : i + size]
            for p in range(len(w) - len(part) + 1):
                if w[p : p + len(part)] == part:
                    hit.update(range(p, p + len(part)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("ab cd ef gh ij kl é1".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(25)] + [(7, "Kl, ab!"), (50, None), (None, "ij ij ij"), (51, "...")]
    texts = HARD + [", ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["-ab cd ef gh-"]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contamination(docs, bench, size=4).collect()
    want = [(r.doc_id, *slow_hits(r.text, items, 4)) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out), key=str) == sorted(want, key=str)
    assert all(r.n_items == len(r["items"]) and r.contaminated == (r.n_hit > 0) for r in out)
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(documents(spark, []), bench).count() == 0


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "small", lambda df, most=0: df)
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "two one")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontam.contamination(docs, items).collect()) == [(1, 3), (2, 0)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha beta"), (4, "alpha x x x x x x beta")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta")], "item_id string, text string")
    out = {r.doc_id: r.distance for r in decontam.proximity(docs, items, slop=2).collect()}
    assert out == {1: 2, 2: 2, 3: 0}


# ---- nearest neighbours


def test_forest_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[::3] = x[0]  # a vector that a third of the rows share
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (2080, [1.0]), (None, [1.0] * 16), (2100, [float("inf")] * 16)]
    out = ann_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=300).toPandas()
    hits = 0
    for q in range(0, 900, 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(900), -score))[:20]
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, score[own.vec_id])
        hits += len(set(own.vec_id) & set(want.tolist()))
        if q % 3 == 0 and (score[want] == score[want][0]).all():
            assert own.vec_id.tolist() == want.tolist()
    assert hits >= 0.9 * 20 * 45 and set(out.query_id) == set(range(0, 900, 20))
    few = ann_forest.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"))
    assert sorted((r.query_id, r.vec_id) for r in few.collect()) == [(0, 1), (0, 2)]
    assert ann_forest.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_forest_rows_of_equal_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in r], 0.5, 7) for i, r in enumerate(x)]
    rows += [(20, [float(v) for v in rng.normal(size=8)], 0.5, 7), rows[40], rows[3]]  # another vector, two repeated rows
    out = ann_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int"), shard_rows=25).collect()
    lists = collections.Counter(r.query_id for r in out)
    assert lists == {0: 20, 20: 40, 40: 20} and all(r.query_id != r.vec_id for r in out)
    for v, ranks in ((rows[20][1], 1), (rows[60][1], 1)):
        score = sorted(((float(np.dot(v, r[1])), -r[0]) for r in rows if r[0] != 20), reverse=True)[0]
        assert any(r.query_id == 20 and r["rank"] == ranks and r.vec_id == -score[1] and math.isclose(r.score, score[0]) for r in out)


# ---- URLs


def test_url_rules_and_templates(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    urls = ["http://A.Example.ORG/es/x", "https://example.org/en/12?q", "https://example.org/en/2#f", "http://x.com/fr/", "http://x.com/de/9", "http://x.com", "http://notorg/a", None, "no scheme", "http://com/fr/a", "http://x.org?y=/z"]
    urls += [f"http://s.net/{a}/{i}" for a in ("p", "q") for i in range(40)] + [f"http://x.com/de/{i}" for i in range(100)] + [f"http://y.net/de/{i}" for i in range(9)] + ["http://h.org/" + "a/" * 5000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_templates.judge(pages, rules).collect()}
    assert len(out) == len(urls)
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(6)] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/9", "com/de/", "block"), ("x.com", "", None, out[5].verdict),
    ]
    assert out[6].rule is None and (out[7].host, out[7].path, out[8].host) == ("", "", "") and out[9].rule == "com/fr/" and out[10].rule is None
    assert out[len(urls) - 2].template == "/de/*" and out[len(urls) - 2].verdict == "block"
    assert url_templates.judge(pages.limit(0), rules).count() == 0


def slow_templates(rows, depth=6, siblings=20, least=0.05, weight=8.0, chance=1.96):
    """Rows (host, path, said) to (template, verdict without a rule) by plain loops over each host's tree."""

    def cut(path):
        parts = re.sub("[0-9]+", "*", path.removeprefix("/")).split("/", depth)
        return [*parts[:depth], "**/" + parts[depth]] if len(parts) > depth else parts

    out = [[] for _ in rows]
    segs = [cut(p) for _, p, _ in rows]
    for level in range(depth + 1):
        groups = collections.defaultdict(list)
        for i, (h, _, _) in enumerate(rows):
            if len(segs[i]) > level:
                groups[h, tuple(out[i])].append(i)
        for own in groups.values():
            n = collections.Counter(segs[i][level] for i in own)
            name = {x: ("**" if x.startswith("**/") else "*") if len(n) > siblings and c < least * len(own) else x for x, c in n.items()}
            said = collections.defaultdict(lambda: [0, 0])
            for i in own:
                said[name[segs[i][level]]][0] += rows[i][2] == "allow"
                said[name[segs[i][level]]][1] += rows[i][2] == "block"
            rate = {k: (b + weight / 2) / (a + b + weight) for k, (a, b) in said.items()}
            branch, last, members = {}, None, []
            for k in sorted((k for k in said if sum(said[k])), key=lambda k: (rate[k], k)):
                noise = last and math.sqrt(sum(rate[x] * (1 - rate[x]) / (sum(said[x]) + weight) for x in (k, last)))
                if last is None or rate[k] - rate[last] > chance * noise:
                    members = []
                members.append(k)
                branch[k], last = members, k
            for i in own:
                k = name[segs[i][level]]
                out[i].append("|".join(sorted(branch.get(k, [k]))))
    allow, block = sum(r[2] == "allow" for r in rows), sum(r[2] == "block" for r in rows)
    overall = (block + 1) / (allow + block + 2)
    alike, leaf = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for r, s, o in zip(rows, segs, out):
        for table, key in ((alike, tuple(s)), (leaf, (r[0], *o))):
            table[key][0] += r[2] == "allow"
            table[key][1] += r[2] == "block"
    for r, s, o in zip(rows, segs, out):
        (a, b), (c, d) = alike[tuple(s)], leaf[r[0], *o]
        share = (d + weight * (b + weight * overall) / (a + b + weight)) / (c + d + weight)
        yield "/" + "/".join(o), r[2] or ("block" if share > 0.5 else "allow"), 1 - share


def test_templates_match_plain_loops(spark):
    rng = random.Random(12)
    rules = [("block", "org/"), ("allow", "org/bad/"), ("block", "com/x/"), ("allow", "com/y/")]
    hosts, names = ["a.org", "b.com", "c.com", "d.net"], ["bad", "x", "y", "news", "tag", "p"]
    paths = ["/".join(["", *(rng.choice(names) for _ in range(rng.randint(0, 3))), *(["".join(rng.choice("abcdefghijkl") for _ in range(5))] if rng.random() < 0.2 else []), *(["deep"] * 6 + [rng.choice("uv")] * 3 if rng.random() < 0.1 else [])]) for _ in range(2500)]
    urls = [f"http://{rng.choice(hosts)}{p}" for p in paths]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls[:50]])], "page_id long, url string")  # repeated rows, too
    out = url_templates.judge(pages, rules).orderBy("page_id").collect()
    fits = lambda r: {"org/": "block", "org/bad/": "allow", "com/x/": "block", "com/y/": "allow"}.get(r)
    want = list(slow_templates([(r.host, r.path, fits(r.rule)) for r in out]))
    assert [(r.template, r.verdict) for r in out] == [w[:2] for w in want]
    assert np.allclose([r.purity for r in out], [w[2] for w in want])
    assert len({r.template for r in out}) > 20 and {r.verdict for r in out if r.rule is None} == {"allow", "block"}


def test_many_siblings_become_a_wildcard(spark):
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    pages = spark.createDataFrame([(i, f"http://a.net/news/{w}") for i, w in enumerate(words)], "page_id long, url string")
    assert {r.template for r in url_templates.judge(pages, []).collect()} == {"/news/*"}


# ---- HTML


@pytest.fixture(scope="module")
def dom():
    return html_extract.fit(html_extract.labelled_pages(600))


def test_main_text(dom):
    page = '<html><head><title>t</title><style>x</style></head><body><nav><ul><li><a href=/a>Home</a></ul></nav><div class="ad">Buy now things</div><article><h1>A &amp;amp; B</h1><p><b>One<br>two.<p>Three &eacute;&nbsp; four</article><footer>&copy; me</footer>'
    assert html_extract.extract(page, dom) == "A &amp; B\nOne two.\nThree é four"
    assert html_extract.extract("", dom) == "" and html_extract.extract("<script>var t='</p>';", dom) == ""


def test_containers_that_nothing_names(dom):
    two = "<p>First paragraph of the article is here, with enough words to be read.</p><p>Second paragraph says more about the same thing.</p>"
    text = "First paragraph of the article is here, with enough words to be read.\nSecond paragraph says more about the same thing."
    assert html_extract.extract(f"<html><body><div>{two}</div></body></html>", dom) == text
    assert html_extract.extract("<p>Only one paragraph stands here.</p>", dom) == "Only one paragraph stands here."
    # Layouts of which no training page is made: columns, menus after the text, deeper nesting.
    menu, foot = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Shop</a></li></ul>', '<div class="footer">All of it is ours</div>'
    for page in (
        f"<body><nav>{menu}</nav><div><div><div>{two}</div></div></div>{foot}</body>",
        f"<body><section>{two}</section><nav>{menu}</nav></body>",
        f"<table><tr><td><nav>{menu}</nav></td><td>{two}</td></tr></table>",
        f"<body><header>{menu}</header><div><section><div>{two}</div></section></div>{foot}</body>",
    ):
        assert html_extract.extract(page, dom) == text, page


def test_held_out_pages(dom):
    wrong = total = 0
    for page, labels in html_extract.labelled_pages(100, seed=77):
        unary = [scale * sum(dom["weights"][i] for i in r) for r, scale in zip(*html_extract.features(page, dom["vocabulary"]))]
        p = html_extract.marginals(page.parent, page.tag, unary, dom)
        wrong += sum((p[k] >= 0.5) != bool(labels[k]) for k in range(page.elements, len(page.tag)))
        total += len(page.runs)
    assert wrong < 0.1 * total


def test_marginals_are_exact():
    rng = random.Random(10)
    tags = ["#root", "div", "p", "li", "div", "p"]
    parent = [-1, 0, 1, 1, 0, 4]
    model = {"couple": [rng.uniform(0.1, 1.5) for _ in html_extract.TAGS]}
    unary = [rng.uniform(-2, 2) for _ in tags]
    mass, total = [0.0] * 6, 0.0
    for state in range(64):
        s = [2 * (state >> k & 1) - 1 for k in range(6)]
        w = math.exp(sum(u * x / 2 for u, x in zip(unary, s)) + sum(model["couple"][html_extract.TAGS[tags[k]]] * s[k] * s[parent[k]] for k in range(1, 6)))
        total += w
        mass = [m + w * (x > 0) for m, x in zip(mass, s)]
    assert np.allclose(html_extract.marginals(parent, tags, unary, model), [m / total for m in mass])


def test_main_text_edge_cases(spark, dom):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p" * 3000), (4, "u", "<div>" * 5000 + "x"), (5, "u", "<article>" + "<p>para</p>" * 20_000 + "</article>"), (5, "u", "<article><p>a</article>")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.main_text(pages, dom).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert {r.text for r in out if r.page_id in (1, 2)} == {""} and max(r.n_chars for r in out) == 20_000 * 5 - 1
    assert html_extract.main_text(pages.limit(0), dom).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pipeline.run(spark, sf_dir)
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < docs.count()
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r["item_id"].as_py(), r["text"].as_py()) for r in map(lambda i: {k: v[i] for k, v in cols.items()}, range(n))] if (cols := {c: pq.read_table(f"{sf_dir}/benchmark.parquet").column(c) for c in ("item_id", "text")}) and (n := len(cols["text"])) else []
    assert not any(slow_hits(rows[i], items, 10)[1] for i in kept)
    sets = [shingle_set(rows[i], 5) for i in sorted(kept)]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(library_ids(rows[i])) + 1 for i in kept)
    for _, stage in pipeline.STAGES[:4]:  # empty tables, other columns
        assert stage(spark, docs.limit(0).selectExpr("*", "1 as _key", "2 as _tox_score"), sf_dir).columns == [*docs.columns, "_key", "_tox_score"]
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns


def test_pipeline_judges_rows_that_share_an_id_one_by_one(spark, tmp_path):
    import corpus_pipeline as pipeline

    long = " ".join(f"w{i}" for i in range(40))
    leak = " ".join(f"item{i}" for i in range(12))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {leak}"), (1, f"{leak} y"), (2, f"z {leak}"), (2, "a clean row of the same id"), (None, "another clean row"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()), key=str) == sorted([rows[3], rows[4], rows[5], rows[6]], key=str)
    rows = [(5, long), (6, long), (6, "a different text of the same id"), (5, long), (None, long), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()), key=str) == sorted([rows[0], rows[2], rows[5], rows[6]], key=str)


def test_language_stage_goes_by_the_network(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(16)
    syllables = {"aa": "ba be bi do du".split(), "zz": "ver zor wim tux yor".split()}
    rows = [(i, " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(2, 5))) for _ in range(60)), k) for i in range(160) for k in [["aa", "zz"][i % 2]]]
    junk = [(500, "".join(rng.choice("abdeiouvrzwmtxy ") for _ in range(2000)), None), (501, "12 34", "aa"), (502, None, "aa")]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in pipeline.keep_languages(spark, docs, "").collect()}
    assert kept == set(range(160))
    kept = {r.doc_id for r in pipeline.keep_languages(spark, docs, "", languages=("zz",)).collect()}
    assert kept == {i for i in range(160) if i % 2}
