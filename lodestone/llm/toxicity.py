"""Toxicity by a character n-gram linear classifier with naive Bayes scaled features.

A feature is a character n-gram of a word with its borders, hashed; a document has it or not. Features are
scaled by the log ratio of their smoothed shares in the documents of either class, those whose shares don't
differ beyond chance are left out, and a logistic regression on the scaled features is fitted in numpy on a
bounded sample of the labelled rows. Scoring reads whole texts: distinct words are looked up in a bounded
cache, so the n-grams of a word are hashed once.

Edge cases: a null or empty text has no feature and gets the score of the intercept; without labels, or with
one class only, every score is the share of label 1 (0 without labels); rows with a null label teach nothing;
a document labelled twice counts as toxic if any label says so; repeated rows each get their row; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import LOWER, Ragged, drawn, held, mix64, ragged_take, scan_words, ship, text_slices, tidied, utf8
from lodestone.llm.fst_tokens import WordTable

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
#: Bounds of the sample for training: documents and bytes of each class.
MOST_DOCS, MOST_BYTES = 1500, 6_000_000
SCAN_BYTES = 1 << 19
#: Remembered words of a task.
SCORER_WORDS = 300_000
_MULT = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % 2**64) for k in range(max(SIZES))]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, which word each is from), in the order of the words."""
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = buf == 32
    owner = np.cumsum(space) - 1
    spaces = np.concatenate([[0], np.cumsum(space)])
    keys = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    grams, owners = [], []
    for n in SIZES:
        at = np.arange(max(0, len(buf) - n + 1))
        at = at[spaces[at + n - 1] == spaces[at + 1]]  # no border strictly inside
        with np.errstate(over="ignore"):
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ keys[at + k]) * _MULT[k] + (h >> np.uint64(29))
        grams.append((mix64(h) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[at])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], owners[order]


class Scorer:
    """The features of a model, and what it remembers of words."""

    def __init__(self, features: np.ndarray):
        self.slot = np.full(BUCKETS, -1, np.int32)
        self.slot[features] = np.arange(len(features))
        self.clear()

    def clear(self) -> None:
        self.table, self.lists = WordTable(), Ragged(np.int32)
        self.lists.add(np.zeros(0, np.int32), np.zeros(1, np.int64))  # list 0: no feature

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, slot of a feature) pairs, sorted."""
        joined, starts, ends, prints, counts = scan_words(texts)
        keys, at, which = np.unique(prints, return_index=True, return_inverse=True)
        if len(self.table) > SCORER_WORDS:
            self.clear()
        lists = self.table.find(keys)
        if len(new := np.flatnonzero(lists < 0)):
            grams, owner = word_features([joined[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            grams = self.slot[grams].astype(np.int64)
            grams, owner = grams[grams >= 0], owner[grams >= 0]
            some, sizes = np.unique(owner, return_counts=True)
            lists[new] = 0
            lists[new[some]] = self.lists.add(grams, sizes)
            self.table.add(keys[new], lists[new])
        of = lists[which]
        hit = np.flatnonzero(of > 0)
        doc, of = np.repeat(np.arange(len(texts)), counts)[hit], of[hit]
        size = self.lists.length[of]
        pairs = np.unique(np.repeat(doc, size) * np.int64(BUCKETS) + ragged_take(self.lists.flat, self.lists.at[of], size))
        return pairs // BUCKETS, pairs % BUCKETS


def fit(texts: list[bytes], toxic: np.ndarray, prior: float, least_z: float = 4.0, rounds: int = 300, decay: float = 1e-3) -> dict:
    """{features, weights, bias}: weights hold the naive Bayes scale; the bias is moved to the prior of label 1."""
    grams = [np.unique(word_features(list(set(t.translate(LOWER).split())))[0].astype(np.int32)) for t in texts]
    doc, gram = np.repeat(np.arange(len(texts)), list(map(len, grams))), np.concatenate(grams)
    y = toxic.astype(np.float64)
    n1, n0 = y.sum(), (1 - y).sum()
    c1 = np.bincount(gram, weights=y[doc], minlength=BUCKETS)
    c0 = np.bincount(gram, minlength=BUCKETS) - c1
    p1, p0 = (c1 + 1) / (n1 + 2), (c0 + 1) / (n0 + 2)
    mean = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0) + 1e-12)
    features = np.flatnonzero(np.abs(z) >= least_z)
    ratio = np.log(p1[features] / p0[features])
    slot = np.full(BUCKETS, -1)
    slot[features] = np.arange(len(features))
    keep = slot[gram] >= 0
    row, col = doc[keep], slot[gram[keep]]
    value = ratio[col]
    w, bias, m, v = np.zeros(len(features)), 0.0, np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    share = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for t in range(1, rounds + 1):
        s = np.bincount(row, weights=value * w[col], minlength=len(y)) + bias
        e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * share
        g = np.append(np.bincount(col, weights=value * e[row], minlength=len(w)) + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return {"features": features.astype(np.int32), "weights": w * ratio, "bias": float(bias + np.log(prior / (1 - prior)))}


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on a hashed sample of the labelled rows that aren't held out (crc32 of the id modulo ``mod`` is ``rest``)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held(id_col, mod, rest)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    matched = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n")).join(known, "id").where("y in (0, 1)")
    sums = matched.groupBy("y").agg(F.count("*").alias("n"), F.sum("n").alias("bytes")).collect()
    have = {r["y"]: r["n"] for r in sums}
    total = sum(have.values())
    if len(have) < 2:
        return {"features": np.zeros(0, np.int32), "weights": np.zeros(0), "bias": None, "share": have[1] / total if 1 in have else 0.0}
    # At most most_docs rows a class: their ids are sent to the texts, never the texts to each other.
    chosen = drawn(matched, "y", "id", "n", most_docs, most_bytes, sums).select("id", "y").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")
    nth = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id", "t")))  # ids may repeat
    rows = texts.withColumn("nth", nth).where(F.col("nth") <= most_docs).select("id", "y", "t").collect()
    rows.sort(key=lambda r: (str(r["id"]), r["t"] or ""))
    y = np.array([r["y"] for r in rows])
    return fit([(r["t"] or "").encode() for r in rows], y, have[1] / total)


def score(docs: DataFrame, model: dict, mod: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """id (and the columns in ``keep``), held_out, score, predicted of every row, where it is read. ``prefix`` keeps the new names apart from kept ones."""
    ship(docs.sparkSession)
    features, weights, bias, share = model["features"].astype(np.int32), model["weights"], model["bias"], model.get("share")
    kept = keep or [id_col]

    def run(batches):
        scorer = Scorer(features)
        for batch in batches:
            for a, b, column in text_slices(batch.column(text_col), SCAN_BYTES):
                texts = utf8(column)
                if bias is None:
                    out = np.full(b - a, share)
                else:
                    d, f = scorer.documents(texts)
                    s = np.bincount(d, weights=weights[f], minlength=b - a) + bias
                    out = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in [*kept, f"{prefix}held_out"]), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[f.name for f in schema])

    own = docs.select(*kept, *([] if text_col in kept else [text_col]), held(id_col, mod, rest).alias(f"{prefix}held_out"))
    schema = T.StructType([*(own.schema[c] for c in [*kept, f"{prefix}held_out"]), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())])
    return own.mapInArrow(tidied(run), schema)
