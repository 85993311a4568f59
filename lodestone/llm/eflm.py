"""Language-model scores from a trigram trie in Elias-Fano levels.

Training and scoring share one exchange. Tasks cut their rows into chunks and send each shard (a range of word
fingerprints) what the chunk holds around the shard's words: for a word v its distinct successors w and predecessors
u, and for each pair (u, v) which of v's successors followed, all with training counts, zeros included. A shard adds
up the counts of all chunks, lays its part of the trie out, answers every chunk's own n-grams from it and sends codes
back, in the order of the question; so scoring needs no second look-up and no table of the corpus travels whole.
Chunks then sum their documents' log probabilities.

A shard's trie lies in one memory-mapped file (in memory: no folder of the machine is used), and questions are
answered from its packed levels, which are never unpacked:

* nodes: Elias-Fano sequence of the words' fingerprints, with counts;
* successors: monotone pointers to each node's list, and the lists as numbers in the shard's own key table, made
  monotone by carrying each list's end over to the next;
* contexts (u, v): a list of predecessors below node v, laid out in the same way;
* trigrams: below each context the places of its words *in the list of v's successors*, small numbers relative to
  the shorter context.

A bigram is found by its node's pointer range and a successor search in it; a trigram by the range of its context and
a successor search for the place that the bigram's search gave. Reads are vectorised over many questions.

The model is interpolated with absolute discounts: p(w | u, v) = a(u, v, w) + b(u, v) p(w | v) and p(w | v) =
a(v, w) + b(v) p(w), with a = (c - D) / c(context), rounded down to a code of one byte; b is what is left to the
context, rounded down likewise, so probabilities of a context never sum to more than 1. The unigram p(w) is
(1 - m) c(w) / N, and m for the one unknown word type, m being the share of words met once (Good and Turing's
estimate of unseen mass). A text's first word has the begin sign as its context.

Two things are taken from a sample of at most about ``SAMPLE_BYTES`` of text, and neither changes a score: the words
that are sent as two bytes instead of six, and the words so frequent that their contexts are dealt to ``GROUPS``
shards each by the predecessor.

Edge cases: a null or empty text is the end token alone; without training rows every token is unknown and scores
log10 of 1; repeated rows count and score as often as they occur; other columns are ignored; an empty table
gives no row. Words are told apart by 64-bit fingerprints, the neighbours of one word by 48 bits.
"""

from __future__ import annotations

import mmap
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import dealt, held, mix64, partitions, scan_words, ship, squeeze, stored, text_slices, tidied, unsqueeze, utf8

#: Tokens of a chunk; bytes of text for each shard; the discount of a count.
CHUNK, SHARD_BYTES, DISCOUNT = 1_500_000, 6_000_000, 0.75
SCAN_BYTES = 1 << 20
#: The sample, words of two bytes, share of the sample's tokens from which a word's contexts are split, and into how many.
SAMPLE_BYTES, COMMON, SPLIT, GROUPS = 48_000_000, 60_000, 1 / 512, 64
BEGIN, END = mix64(np.array([1, 2], np.uint64))
_KEY = np.uint64(16)  # 64 - 48 bits
#: Quantised probabilities: code c stands for 10^(-c * STEP), the last one for 0; what is left to a context is finer.
STEP, FINE, FINE3 = 0.03, 1e-4, 0.02


# ---------------------------------------------------------------- Elias-Fano sequences and the trie


def ef_pack(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """[head (length, low bits), low parts, high parts] of a non-decreasing sequence of unsigned numbers below the universe."""
    n = len(values)
    low = min(56, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
    values = values.astype(np.uint64)
    lows = np.packbits((values[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(bool), bitorder="little") if low else np.zeros(0, np.uint8)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(-(-(int(high[-1]) + 1 if n else 1) // 64) * 64, bool)
    bits[high] = True
    return [np.array([n, low], np.int64), np.append(lows, np.zeros(8, np.uint8)), np.packbits(bits, bitorder="little").view(np.uint64)]


#: Place of the n-th one of each byte, at 8 * byte + n.
_NTH_ONE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).reshape(-1)


class EliasFano:
    """A packed sequence over buffers: vectorised reads of single places and successor searches."""

    def __init__(self, head: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.highs = int(head[0]), int(head[1]), highs
        # Eight bytes from any byte on; and how many ones stand before each word: the directory for select.
        self.lows = np.ndarray((len(lows) - 7,), "<u8", lows.data if len(lows) else b"", strides=(1,))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(highs), dtype=np.int64)])
        self.zeros = 64 * np.arange(len(self.before)) - self.before

    @staticmethod
    def _select(bits: np.ndarray, word: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Place of the ``rest``-th one of ``bits``, the contents of words number ``word``."""
        place = word << 6
        for width in (32, 16, 8):  # halve the word that holds the one looked for, down to its byte
            ones = np.bitwise_count(bits & np.uint64((1 << width) - 1))
            up = rest >= ones
            rest = rest - ones * up
            step = up * np.uint8(width)
            place += step
            bits = bits >> step
        return place + _NTH_ONE[(bits & np.uint64(255)).astype(np.int64) << 3 | rest]

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at the places ``at``: select in the high part, a shift in the low part."""
        word = np.searchsorted(self.before, at, side="right") - 1
        place = self._select(self.highs[word], word, at - self.before[word])
        out = (place - at).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            first = at * self.low
            out |= (self.lows[first >> 3] >> (first & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)
        return out

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``high``: the ones before the zero that ends it."""
        nth = high - 1
        word = np.searchsorted(self.zeros, nth, side="right") - 1
        some = (nth >= 0) & (nth < self.zeros[-1])
        out = np.where(nth < 0, 0, self.n)
        word, nth = word[some], nth[some]
        out[some] = self._select(~self.highs[word], word, nth - self.zeros[word]) - nth
        return out

    def successor(self, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
        """First place from each a to before its b whose value is at least x (b if none)."""
        a, b = a.copy(), b.copy()
        if len(wide := np.flatnonzero(b - a > 4)):  # values of the same high part only
            high = (x[wide] >> np.uint64(self.low)).astype(np.int64)
            a[wide], b[wide] = (np.clip(self._below(h), a[wide], b[wide]) for h in (high, high + 1))
        live = np.flatnonzero(a < b)
        while len(live):
            m = (a[live] + b[live]) >> 1
            less = self.get(m) < x[live]
            a[live[less]] = m[less] + 1
            b[live[~less]] = m[~less]
            live = live[a[live] < b[live]]
        return a


def quantise(p: np.ndarray, step: float, most: int) -> np.ndarray:
    """Codes of probabilities, rounded down."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log10(p) / step - 1e-9), most).astype(np.int64)


def restore(codes: np.ndarray, step: float, most: int) -> np.ndarray:
    return np.where(codes >= most, 0.0, 10.0 ** (-codes * step))


def _lists(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Packed pointers and values of rising lists, each shifted by where the one before it ended."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    ends[some] = values[starts[1:][some] - 1]
    shift = np.cumsum(ends) - ends
    return [*ef_pack(starts, len(values) + 1), *ef_pack(values + np.repeat(shift, sizes), int(ends.sum()) + 1)]


def _smoothed(n: np.ndarray, of: np.ndarray, contexts: int, step: float, most: int, kind) -> list[np.ndarray]:
    """Codes of the discounted shares of counts within their contexts, and of what is left to each context."""
    total = np.bincount(of, weights=n, minlength=contexts)
    codes = quantise(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[of], STEP, 255) if len(of) else np.zeros(0, np.int64)
    left = 1 - np.bincount(of, weights=restore(codes, STEP, 255), minlength=contexts)
    return [codes.astype(np.uint8), quantise(np.maximum(left, 1e-6), step, most).astype(kind)]


class Trie:
    """One shard: nodes, key table, successors, contexts, trigrams, with counts and codes, over one buffer."""

    LEVELS = ("nodes", "keys", "to2", "next2", "to1", "prev", "to3", "next3")

    def __init__(self, buffer):
        at, parts = 0, []
        for _ in range(3 * len(self.LEVELS) + 5):
            n, kind = np.frombuffer(buffer, np.int64, 2, at)
            parts.append(np.frombuffer(buffer, np.dtype(chr(kind)), int(n), at + 16))
            at += 16 + -(-parts[-1].nbytes // 8) * 8
        for i, f in enumerate(self.LEVELS):
            setattr(self, f, EliasFano(*parts[3 * i : 3 * i + 3]))
        self.counts, self.codes2, self.back2, self.codes3, self.back3 = parts[-5:]

    @staticmethod
    def build(nodes: np.ndarray, counts: np.ndarray, e: tuple, p: tuple, t: tuple) -> bytes:
        """From sorted nodes with counts; e: (node, key, count) and p: (node, key) rows, sorted; t: (place in p, place in e, count) rows, sorted."""
        (of2, key2, n2), (of1, key1), (of3, to, n3) = e, p, t
        keys = np.unique(np.concatenate([key2, key1]))
        size2, size1, size3 = np.bincount(of2, minlength=len(nodes)), np.bincount(of1, minlength=len(nodes)), np.bincount(of3, minlength=len(of1))
        start2 = np.cumsum(size2) - size2
        within = to - start2[of2[to]] if len(to) else to
        parts = [*ef_pack(nodes, 1 << 64), *ef_pack(keys, 1 << 48), *_lists(np.searchsorted(keys, key2), size2), *_lists(np.searchsorted(keys, key1), size1), *_lists(within, size3)]
        parts += [counts.astype(np.int64), *_smoothed(n2, of2, len(nodes), FINE, 65535, np.uint16), *_smoothed(n3, of3, len(of1), FINE3, 255, np.uint8)]
        out = []
        for a in parts:
            raw = a.tobytes()
            out += [np.array([len(a), ord(a.dtype.char)], np.int64).tobytes(), raw, b"\0" * (-len(raw) % 8)]
        return b"".join(out)

    @staticmethod
    def _search(to: EliasFano, lists: EliasFano, which: np.ndarray, of: np.ndarray, x: np.ndarray, ok: np.ndarray):
        """For questions x in the lists ``which[of]``: (their places, or -1; where each list begins)."""
        first, last = to.get(which), to.get(which + 1)
        first, last = first.astype(np.int64), last.astype(np.int64)
        shift = np.zeros(len(which), np.uint64)
        late = np.flatnonzero((first > 0) & (first < last))
        shift[late] = lists.get(first[late] - 1)
        at, found = np.full(len(of), -1, np.int64), np.flatnonzero(ok)
        a, b, wanted = first[of[found]], last[of[found]], x[found].astype(np.uint64) + shift[of[found]]
        many = np.flatnonzero(b - a > 1)  # a list of one needs no search
        a[many] = lists.successor(a[many], b[many], wanted[many])
        inside = np.flatnonzero(a < b)
        hit = inside[lists.get(a[inside]) == wanted[inside]]
        at[found[hit]] = a[hit]
        return at, first

    def _numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of keys in the shard's key table, and whether they stand there."""
        some, which = np.unique(keys, return_inverse=True)
        at = self.keys.successor(np.zeros(len(some), np.int64), np.full(len(some), self.keys.n), some)
        inside = at < self.keys.n
        inside[inside] = self.keys.get(at[inside]) == some[inside]
        return at[which], inside[which]

    def ask(self, q: dict) -> list[np.ndarray]:
        """Counts and codes of b for each node, codes of a for each successor, of b for each context, of a for each trigram."""
        n = len(q["nodes"])
        node = self.nodes.successor(np.zeros(n, np.int64), np.full(n, self.nodes.n), q["nodes"])
        known = node < self.nodes.n
        known[known] = self.nodes.get(node[known]) == q["nodes"][known]
        node[~known] = 0
        counts, back2 = np.zeros(n, np.int64), np.zeros(n, np.uint16)
        codes2, back3, codes3 = np.full(len(q["key2"]), 255, np.uint8), np.zeros(len(q["key1"]), np.uint8), np.full(len(q["to3"]), 255, np.uint8)
        if known.any():
            counts[known], back2[known] = self.counts[node[known]], self.back2[node[known]]
            of2, of1 = np.repeat(np.arange(n), q["size2"]), np.repeat(np.arange(n), q["size1"])
            number, stands = self._numbers(np.concatenate([q["key2"], q["key1"]]))
            m = len(of2)
            at2, first2 = self._search(self.to2, self.next2, node, of2, number[:m], stands[:m] & known[of2])
            codes2[at2 >= 0] = self.codes2[at2[at2 >= 0]]
            at1, _ = self._search(self.to1, self.prev, node, of1, number[m:], stands[m:] & known[of1])
            back3[at1 >= 0] = self.back3[at1[at1 >= 0]]
            # A trigram's word is known by its place among the successors of the shorter context.
            of3 = np.repeat(np.arange(len(of1)), q["size3"])
            asked = np.cumsum(q["size2"]) - q["size2"]
            short = at2[asked[of1[of3]] + q["to3"]] if len(of3) else of3
            place = short - first2[of1[of3]] if len(of3) else short
            if self.to3.n > 1 and len(of3):
                at3, _ = self._search(self.to3, self.next3, np.maximum(at1, 0), of3, np.maximum(place, 0), (short >= 0) & (at1 >= 0)[of3])
                codes3[at3 >= 0] = self.codes3[at3[at3 >= 0]]
        return [counts, back2, codes2, back3, codes3]


# ---------------------------------------------------------------- chunks and shards


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of the words and end sign of each text, number of tokens of each)."""
    _, _, _, words, counts = scan_words(texts)
    out = np.empty(len(words) + len(texts), np.uint64)
    ends = np.cumsum(counts + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[ends], out[inside] = END, words
    return out, counts + 1


def common_words(docs: DataFrame, text_col: str, bytes_: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted fingerprints of the sample's most frequent words, of those whose contexts are split)."""

    def count(batches):
        for batch in batches:
            for _, _, column in text_slices(batch.column(0), SCAN_BYTES):
                words, n = np.unique(_stream(utf8(column))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    some = docs.select(text_col).sample(min(1.0, SAMPLE_BYTES / max(1, bytes_)), seed=3).mapInArrow(tidied(count), "word long, n long")
    rows = some.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON).collect()
    words, n = np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows])
    split = words[(n >= SPLIT * n.sum()) & (words != END)] if len(n) else words
    return np.sort(words), np.sort(split)


def layout(stream: np.ndarray, sizes: np.ndarray, words: int, split: np.ndarray, group: np.ndarray, ranked) -> dict:
    """The chunk's n-grams as lists below nodes, and where each token's n-grams stand in them.

    Nodes are the words, the begin sign (number ``words``) and, for words that are split, one for each group of
    predecessors; ``ranked`` gives the places of all but the words among all nodes from (word, group) rows.
    """
    firsts = np.cumsum(sizes) - sizes
    prev = np.empty(len(stream), np.int64)
    prev[1:], prev[firsts] = stream[:-1], words
    third = np.ones(len(stream), bool)
    third[firsts] = False
    third = np.flatnonzero(third)
    before, mid = prev[third - 1], prev[third]
    apart = np.flatnonzero(split[mid])
    pairs, which = np.unique(mid[apart] * GROUPS + group[before[apart]], return_inverse=True)
    ranks = ranked(pairs // GROUPS, pairs % GROUPS)
    total = words + len(ranks)
    place = np.empty(total, np.int64)
    place[words:] = ranks
    place[:words] = np.delete(np.arange(total), ranks)
    node = place[mid]
    node[apart] = place[words + 1 + which]
    wide = words + 1
    e, at = np.unique(np.concatenate([place[prev] * wide + stream, node[apart] * wide + stream[third[apart]]]), return_inverse=True)
    of2 = e // wide
    size2 = np.bincount(of2, minlength=total)
    two, own = at[: len(stream)], at[third]
    own[apart] = at[len(stream) :]
    own -= (np.cumsum(size2) - size2)[node]
    p, one = np.unique(node * wide + before, return_inverse=True)
    deep = int(own.max(initial=0)) + 1
    t, three = np.unique(one * deep + own, return_inverse=True)
    return {"place": place, "ranks": ranks, "of2": of2, "to2": e % wide, "size2": size2, "from1": p % wide, "size1": np.bincount(p // wide, minlength=total), "size3": np.bincount(t // deep, minlength=len(p)), "to3": t % deep, "third": third, "prev": prev, "two": two, "one": one, "three": three}


def bundle(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unbundle(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    cuts = np.concatenate([[0], np.cumsum(np.frombuffer(b, np.int64, n, 8))]) + 8 * (n + 1)
    return [b[x:y] for x, y in zip(cuts.tolist(), cuts.tolist()[1:])]


def _pack_keys(fps: np.ndarray, codes: np.ndarray, which: np.ndarray) -> list[bytes]:
    """Words as two-byte codes where they have one, else as six bytes of their fingerprint."""
    code = codes[which]
    rare = which[code < 0]
    return [np.packbits(code >= 0).tobytes(), squeeze(code[code >= 0].astype(np.uint16)), np.ascontiguousarray((fps[rare] >> _KEY).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()]


def _read_keys(parts: list[bytes], n: int, common: np.ndarray) -> np.ndarray:
    hit = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=n).astype(bool)
    out, rare = np.empty(n, np.uint64), np.zeros((n - int(hit.sum()), 8), np.uint8)
    rare[:, :6] = np.frombuffer(parts[2], np.uint8).reshape(-1, 6)
    out[hit], out[~hit] = common[unsqueeze(parts[1], np.uint16)] >> _KEY, rare.view("<u8").reshape(-1)
    return out


def _questions(prints: np.ndarray, sizes: np.ndarray, train: np.ndarray, shards: int, common: np.ndarray, split: np.ndarray):
    """(shard, blob) questions of a chunk, and the blob from which its documents are scored."""
    fps, stream = np.unique(prints, return_inverse=True)
    words = len(fps)
    fps = np.append(fps, BEGIN)
    at = np.minimum(np.searchsorted(common, fps), max(0, len(common) - 1))
    codes = np.where(common[at] == fps, at, -1) if len(common) else np.full(len(fps), -1)
    apart, group = np.isin(fps, split), (fps >> np.uint64(58)).astype(np.uint8)  # 64 groups
    apart[words] = False
    nodes = None

    def ranked(word, part):
        nonlocal nodes
        extra = np.append(BEGIN, mix64(fps[word] ^ mix64(part.astype(np.uint64) + np.uint64(11))))
        nodes = np.sort(np.concatenate([fps[:words], extra]))
        return np.searchsorted(nodes, extra)

    x = layout(stream, sizes, words, apart, group, ranked)
    learns = np.repeat(train, sizes)
    count = np.zeros(len(nodes), np.int64)
    count[x["place"][:words]] = np.bincount(stream, weights=learns, minlength=words)
    n2 = np.bincount(x["two"], weights=learns, minlength=len(x["to2"])).astype(np.uint32)
    n3 = np.bincount(x["three"], weights=learns[x["third"]], minlength=len(x["to3"])).astype(np.uint32)
    edges = np.array([(1 << 64) * s // shards for s in range(1, shards)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(nodes, edges), [len(nodes)]]).astype(np.int64)
    upto = lambda sizes_, c: np.concatenate([[0], np.cumsum(sizes_)])[c]
    c2, c1 = upto(x["size2"], cut), upto(x["size1"], cut)
    c3 = upto(x["size3"], c1)
    rows = []
    for s in np.flatnonzero(np.diff(cut)).tolist():
        n, e, p, t = (slice(c[s], c[s + 1]) for c in (cut, c2, c1, c3))
        small = [x["size2"][n], n2[e], x["size1"][n], x["size3"][p], x["to3"][t], n3[t]]
        rows.append((s, bundle([squeeze(nodes[n]), squeeze(count[n]), *(squeeze(a.astype(np.uint32)) for a in small), *_pack_keys(fps, codes, x["to2"][e]), *_pack_keys(fps, codes, x["from1"][p])])))
    own = [squeeze(stream.astype(np.uint32)), squeeze(sizes.astype(np.int64)), squeeze(np.flatnonzero(apart).astype(np.uint32)), group.tobytes(), squeeze(x["ranks"].astype(np.uint32))]
    return rows, own


def _read(blob: bytes, common: np.ndarray) -> dict:
    b = unbundle(blob)
    q = {"nodes": unsqueeze(b[0], np.uint64), "counts": unsqueeze(b[1], np.int64)}
    q |= {f: unsqueeze(x, np.uint32).astype(np.int64) for f, x in zip(("size2", "n2", "size1", "size3", "to3", "n3"), b[2:8])}
    return q | {"key2": _read_keys(b[8:11], len(q["n2"]), common), "key1": _read_keys(b[11:14], len(q["size3"]), common)}


def _merged(of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (of, key) rows in their order, and which of them each row is."""
    if len(of) and int(of.max()) < 1 << 16:  # both in one number
        both, which = np.unique(of.astype(np.uint64) << np.uint64(48) | key, return_inverse=True)
        return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1), which
    order = np.lexsort((key, of))
    a, b = of[order], key[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return a[new], b[new], which


def serve(parts: list[dict]):
    """Lays the shard's trie out from all chunks' questions and asks it each distinct one once: its (tokens, words, words met once), then each chunk's answers."""
    join = lambda f: np.concatenate([q[f] for q in parts])
    nodes, where = np.unique(join("nodes"), return_inverse=True)
    counts = np.bincount(where, weights=join("counts"), minlength=len(nodes)).astype(np.int64)
    size2, size1, size3 = join("size2"), join("size1"), join("size3")
    of1 = np.repeat(np.arange(len(where)), size1)
    of2, key2, which2 = _merged(np.repeat(where, size2), join("key2"))
    n2 = np.bincount(which2, weights=join("n2"), minlength=len(of2)).astype(np.int64)
    node1, key1, which1 = _merged(where[of1], join("key1"))
    ctx = np.repeat(which1, size3)
    to = which2[np.repeat((np.cumsum(size2) - size2)[of1], size3) + join("to3")]
    t, which3 = np.unique(ctx * max(1, len(of2)) + to, return_inverse=True)
    del ctx, to, of1
    n3 = np.bincount(which3, weights=join("n3"), minlength=len(t)).astype(np.int64)
    ctx, to = np.divmod(t, max(1, len(of2)))
    # Only what training rows hold is laid out: contexts with a trigram, successors with a count or a trigram.
    seen = n3 > 0
    keep2, keep1 = n2 > 0, np.zeros(len(node1), bool)
    keep2[to[seen]] = keep1[ctx[seen]] = True
    new2, new1 = np.cumsum(keep2) - 1, np.cumsum(keep1) - 1
    trie = Trie(_mapped(Trie.build(nodes, counts, (of2[keep2], key2[keep2], n2[keep2]), (node1[keep1], key1[keep1]), (new1[ctx[seen]], new2[to[seen]], n3[seen]))))
    yield int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum())
    del counts, n2, n3, seen, keep1, keep2, new1, new2, t
    each2 = np.bincount(of2, minlength=len(nodes))
    within = to - (np.cumsum(each2) - each2)[node1[ctx]] if len(ctx) else to
    asked = {"nodes": nodes, "key2": key2, "size2": each2, "key1": key1, "size1": np.bincount(node1, minlength=len(nodes)), "size3": np.bincount(ctx, minlength=len(node1)), "to3": within}
    del of2, node1, ctx, to
    found = trie.ask(asked)
    lengths = np.array([[len(q[f]) for f in ("nodes", "nodes", "key2", "key1", "to3")] for q in parts])
    cuts = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(lengths, axis=0)])
    for a, b in zip(cuts, cuts[1:]):
        yield [x[i[k:m]] for x, i, k, m in zip(found, (where, where, which2, which1, which3), a, b)]


def _mapped(raw: bytes) -> mmap.mmap:
    """The trie as a mapped file that lives in memory only."""
    if not hasattr(os, "memfd_create"):
        room = mmap.mmap(-1, max(1, len(raw)))
        room[: len(raw)] = raw
        return room
    f = os.memfd_create("trie")
    try:
        with os.fdopen(os.dup(f), "wb") as out:
            out.write(raw)
        return mmap.mmap(f, max(1, len(raw)), prot=mmap.PROT_READ)
    finally:
        os.close(f)


def score(docs: DataFrame, mod: int = 7, rest: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, chunk_tokens: int = CHUNK) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from those that aren't held out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // shard_bytes))
    common, split = common_words(docs, text_col, size)
    kind = docs.schema[id_col].dataType
    base = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.BinaryType()), T.StructField("b", T.BinaryType())])
    answered = T.StructType([*base.fields, *(T.StructField(c, T.LongType()) for c in ("tokens", "words", "once"))])

    def rows(values, schema):
        target = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*values), target)], schema=target)

    def read(batches):
        parts, size, n = ([], [], [], []), 0, 0
        task = TaskContext.get().partitionId() if TaskContext.get() else 0  # the same when a task runs again

        def chunk_rows():
            ids, held_out, prints, sizes = parts
            held_out, whole = np.concatenate(held_out), np.concatenate(prints)
            prints.clear()
            asked, own = _questions(whole, np.concatenate(sizes), ~held_out, shards, common, split)
            del whole
            chunk = task << 24 | n
            for s, b in asked:
                yield rows([(s, chunk, None, None, b)], base)
            yield rows([(-1, chunk, [x for c in ids for x in c.to_pylist()], held_out.tobytes(), bundle(own))], base)

        for batch in batches:
            flags = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, column in text_slices(batch.column(1), SCAN_BYTES):
                prints, sizes = _stream(utf8(column))
                for p, x in zip(parts, (batch.column(0).slice(a, b - a), flags[a:b], prints, sizes)):
                    p.append(x)
                size += len(prints)
                if size >= chunk_tokens:
                    yield from chunk_rows()
                    parts, size, n = ([], [], [], []), 0, n + 1
        if size:
            yield from chunk_rows()

    def answer(batches):
        asked: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] < 0:
                    yield rows([(*(r[f] for f in base.names), None, None, None)], answered)
                else:
                    asked.setdefault(r["shard"], []).append((r["chunk"], r["b"]))
        for s in list(asked):
            chunks, blobs = zip(*asked.pop(s))
            read_, blobs = [_read(b, common) for b in blobs], None
            found = serve(read_)
            sums = next(found)
            for chunk in chunks:
                yield rows([(s, chunk, None, None, bundle([squeeze(a) for a in next(found)]), *sums)], answered)
                sums = (0, 0, 0)

    own = docs.select(id_col, text_col, held(id_col, mod, rest).alias("held"))
    home = F.when(F.col("shard") >= 0, F.col("shard")).otherwise(F.pmod(F.xxhash64("chunk"), F.lit(shards)))
    sent = dealt(own.mapInArrow(tidied(read), base), shards, home)
    back = stored(sent.mapInArrow(tidied(answer), answered), "answers")
    sums = back.agg(F.sum("tokens"), F.sum("words"), F.sum("once")).first()
    n, v, once = (int(x or 0) for x in sums)
    unseen = (once if once else 1) / (n + 1) if n else 1.0
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, t) for c, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))])

    def scored(row: tuple, parts: list) -> pa.RecordBatch:
        """One chunk's rows; its arrays are gone when the next one is unpacked."""
        ids, flags, blob = row
        stream, sizes, apart, group, ranks = unbundle(blob)
        stream, sizes, group, ranks = unsqueeze(stream, np.uint32).astype(np.int64), unsqueeze(sizes, np.int64), np.frombuffer(group, np.uint8), unsqueeze(ranks, np.uint32).astype(np.int64)
        split_ = np.zeros(len(group), bool)
        split_[unsqueeze(apart, np.uint32)] = True
        x = layout(stream, sizes, len(group) - 1, split_, group, lambda word, part: ranks)
        got = [unbundle(b) for _, b in sorted(parts)]
        counts, back2, codes2, back3, codes3 = (np.concatenate([unsqueeze(g[i], k) for g in got]) for i, k in enumerate((np.int64, np.uint16, np.uint8, np.uint8, np.uint8)))
        place = x["place"]
        token = counts[place[stream]]
        p = np.where(token > 0, (1 - unseen) * token / max(n, 1), unseen)
        p = restore(codes2[x["two"]].astype(np.float64), STEP, 255) + 10.0 ** (back2[place[x["prev"]]] * -FINE) * p
        third = x["third"]
        p[third] = restore(codes3[x["three"]].astype(np.float64), STEP, 255) + 10.0 ** (back3[x["one"]] * -FINE3) * p[third]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda y: np.bincount(doc, weights=y, minlength=len(sizes))
        known = add(token > 0).astype(np.int64)
        plain = add(np.log10((token + 1) / (n + v + 1)))
        out = [pa.array(ids, schema_ids), pa.array(np.frombuffer(flags, bool)), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n, np.int64)), pa.array(plain), pa.array(add(np.log10(p)))]
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    def finish(batches):
        answers: dict[int, list] = {}
        streams: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] < 0:
                    streams[r["chunk"]] = (r["ids"], r["held"], r["b"])
                else:
                    answers.setdefault(r["chunk"], []).append((r["shard"], r["b"]))
        for chunk in list(streams):
            yield scored(streams.pop(chunk), answers.pop(chunk))

    from pyspark.sql.pandas.types import to_arrow_type

    schema_ids = to_arrow_type(kind)
    return back.drop("tokens", "words", "once").repartition(shards, "chunk").mapInArrow(tidied(finish), schema)
