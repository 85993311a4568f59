"""Language identification by a byte convolutional network in numpy.

A text is cut into consecutive windows of fixed length (the last one padded with zero bytes). Filters of
several widths slide over one-hot bytes, the largest response of each in the window passes a ReLU, and a dense
layer with softmax gives the language of the window; a text's probabilities are the mean over its windows,
weighted by their bytes. Training (Adam on cross-entropy, gradients through the pooled positions only) runs in
numpy on a bounded sample of labelled rows. For inference each filter bank is folded into tables over byte
pairs, so a window costs a few table rows per byte.

One more class than languages is learnt: bytes in no order. Windows of labelled text with their bytes shuffled stand
for it, so the network also says how much of a text is language of any kind (``language_share``). Windows of all
lengths are trained on, and short ones are rarely shuffled, as few bytes tell little.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is every text when nothing is
labelled; with one language it is that language with score 1. Rows without a language teach nothing; repeated
rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import LOWER, drawn, held, ragged_take, ship, text_slices, tidied, utf8

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
#: Bounds of the sample for training, for each language: documents, bytes, windows.
MOST_DOCS, MOST_BYTES, MOST_WINDOWS = 600, 2_000_000, 1500
#: Windows that are scored at a time, and bytes of texts.
BATCH, SCAN_BYTES = 512, 1 << 19
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as rows of bytes, the text of each, bytes of text in each)."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-length // size)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    filled = np.minimum(length[owner] - nth * size, size)
    buf = np.frombuffer(b"".join(texts).translate(LOWER), np.uint8)
    out = np.zeros((len(owner), size), np.uint8)
    cells = ragged_take(np.arange(out.size), np.arange(len(owner)) * size, filled)
    out.reshape(-1)[cells] = buf
    return out, owner, filled


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 7) -> dict:
    """Train on windows ``x`` with classes ``y``: {filters: one (width, 256, FILTERS) array a width, bias, dense, offset}."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    dense = rng.normal(0, 0.1, (len(bias), classes)).astype(np.float32)
    params = [*filters, bias, dense, np.zeros(classes, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            b = x[order[at : at + batch]]
            t = y[order[at : at + batch]]
            pooled, tops = [], []
            for w, k in zip(WIDTHS, params):
                n = b.shape[1] - w + 1
                conv = k[0][b[:, :n]]
                for i in range(1, w):
                    conv += k[i][b[:, i : i + n]]
                tops.append(conv.argmax(axis=1))
                pooled.append(np.take_along_axis(conv, tops[-1][:, None], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1) + params[-3]
            h = np.maximum(z, 0)
            p = _softmax(h @ params[-2] + params[-1])
            p[np.arange(len(t)), t] -= 1
            p /= len(t)
            gh = (p @ params[-2].T) * (z > 0)
            grads = [np.zeros_like(k) for k in params[: len(WIDTHS)]]
            cols = np.broadcast_to(np.arange(FILTERS), (len(b), FILTERS))
            for j, (w, top) in enumerate(zip(WIDTHS, tops)):
                g = gh[:, j * FILTERS : (j + 1) * FILTERS]
                for i in range(w):
                    np.add.at(grads[j][i], (np.take_along_axis(b, top + i, axis=1), cols), g)
            grads += [gh.sum(axis=0), h.T @ p, p.sum(axis=0)]
            step += 1
            for k, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                k -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return {"filters": params[: len(WIDTHS)], "bias": params[-3], "dense": params[-2], "offset": params[-1]}


class Network:
    """A trained model folded into tables over byte pairs."""

    def __init__(self, model: dict):
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, -1)
        self.tables = []
        for k in model["filters"]:
            parts = [pair(k[i], k[i + 1]) if i + 1 < len(k) else k[i] for i in range(0, len(k), 2)]
            self.tables.append((len(k), [np.ascontiguousarray(p) for p in parts]))
        self.model = model

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax over the languages for each window."""
        out = []
        for at in range(0, len(x), BATCH):
            b = np.ascontiguousarray(x[at : at + BATCH].T)  # position first: pooling runs over whole rows
            pairs = b[:-1].astype(np.int32) * 256 + b[1:]
            pooled = []
            for w, parts in self.tables:
                top = None
                for p in range(b.shape[0] - w + 1):
                    conv = parts[0][pairs[p]]
                    for i, table in enumerate(parts[1:], 1):
                        conv += table[pairs[p + 2 * i]] if p + 2 * i < len(pairs) and len(table) > 256 else table[b[p + 2 * i]]
                    top = conv if top is None else np.maximum(top, conv, out=top)
                pooled.append(top)
            h = np.maximum(np.concatenate(pooled, axis=1) + self.model["bias"], 0)
            out.append(_softmax((h @ self.model["dense"] + self.model["offset"]).astype(np.float64)))
        return np.concatenate(out) if out else np.zeros((0, len(self.model["offset"])))

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text."""
        x, owner, filled = windows(texts)
        p = self.probabilities(x)
        total = np.bincount(owner, weights=filled, minlength=len(texts))
        return np.stack([np.bincount(owner, weights=filled * p[:, c], minlength=len(texts)) for c in range(p.shape[1])], axis=1) / np.maximum(total, 1)[:, None]


def train(docs: DataFrame, mod: int = 4, rest: int = 2, most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES, most_windows: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Fit on a hashed sample, within the bounds for each language, of the labelled rows that aren't held out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held(id_col, mod, rest)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"), F.col(id_col).cast("string").alias("id"))
    known = known.withColumn("n", F.octet_length("t").cast("long"))
    sums = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n").alias("bytes")).collect()
    langs = sorted(r["lang"] for r in sums)
    if len(langs) < 2:
        return {"langs": langs}
    rows = drawn(known, "lang", "id", "n", most_docs, most_bytes, sums).select("lang", "t", "id").collect()
    rows.sort(key=lambda r: (r["lang"], r["id"] or "", r["t"]))
    rng = np.random.default_rng(11)
    xs, ys = [], []
    for c, lang in enumerate(langs):
        x, _, filled = windows([r["t"].encode() for r in rows if r["lang"] == lang])
        x = x[filled >= min(WINDOW, 16)]
        x = x[rng.permutation(len(x))[:most_windows]]
        short = x[: len(x) // 6].copy()  # the same windows, cut off early
        upto = rng.integers(8, 96, len(short))
        short[np.arange(WINDOW) >= upto[:, None]] = 0
        noise = x[len(x) // 6 : len(x) // 6 + len(x) // (len(langs) + 1)].copy()
        for row in noise:
            n = np.count_nonzero(row)
            row[:n] = row[:n][rng.permutation(n)]
        xs += [x, short, noise]
        ys += [np.full(len(x) + len(short), c), np.full(len(noise), len(langs))]
    x, y = np.concatenate(xs), np.concatenate(ys)
    return {"langs": langs} | (fit(x, y, len(langs) + 1) if len(x) else {})


def predict(docs: DataFrame, model: dict, mod: int = 4, rest: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """id (and the columns in ``keep``), held_out, lang_pred, score, language_share of every row, where it is read.

    ``score`` is the predicted language's share of what the network takes for language, and ``language_share`` how much
    of the text that is. ``prefix`` keeps the new names apart from kept ones.
    """
    ship(docs.sparkSession)
    kept, langs = keep or [id_col], model["langs"]

    def run(batches):
        net = Network(model) if "dense" in model else None
        for batch in batches:
            for a, b, column in text_slices(batch.column(text_col), SCAN_BYTES):
                raw = utf8(column)
                some = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
                if net:
                    p = net.texts(raw)
                    share = 1 - p[:, -1]
                    p = p[:, :-1] / np.maximum(share, 1e-12)[:, None]
                    best = p.argmax(axis=1)
                    score = np.clip(p[np.arange(len(p)), best], 0, 1)
                else:
                    best, score, share = np.zeros(b - a, int), np.full(b - a, float(len(langs) == 1)), np.ones(b - a)
                    some &= len(langs) == 1
                said = [langs[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in [*kept, f"{prefix}held_out"]), pa.array(said, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(np.where(some, np.clip(share, 0, 1), 0.0))], names=[f.name for f in schema])

    own = docs.select(*kept, *([] if text_col in kept else [text_col]), held(id_col, mod, rest).alias(f"{prefix}held_out"))
    schema = T.StructType([*(own.schema[c] for c in [*kept, f"{prefix}held_out"]), T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}language_share", T.DoubleType())])
    return own.mapInArrow(tidied(run), schema)
