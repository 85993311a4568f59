"""Token counts by compiled finite-state transducers.

Two deterministic machines replace the tokenizer library on the hot path:

* ``Scanner`` cuts texts into pre-tokens. Its input alphabet holds the character classes of the
  byte-level pattern, refined by a look at the next characters, so eight states suffice. Texts are laid
  end to end and cut into chunks of fixed length; each chunk's map from entry state to exit state is
  found for all states at once, the maps compose by a parallel prefix scan, and a second pass from the
  known entry states marks the boundaries.
* ``TokenFst`` reads the bytes of the texts and starts anew at each pre-token. A state holds the suffix that may
  still grow into a token and, for each place where such a token could begin, the token that ends there; a
  transition carries the change of the number of tokens. States and transitions are compiled when first met, into
  a table that is asked for a whole column of bytes at a time.

Bytes are cut into chunks of fixed length. A chunk's map takes a state of entry to the state of exit and the tokens
emitted on the way. Where a pre-token begins in the chunk, what follows is the same for all entries and is read at once
for all chunks; only the bytes before it wait for the entry. A chunk inside one long pre-token has a map over the states
that can be met there: those that the bytes before it lead to, closed under the maps of the chunks that follow each
other. Such maps compose by a parallel prefix scan, equal chunks share one map, and the counts add up along the chunks.

Results equal the library's for every text: special strings inside a text are one token each, as by default.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows each get their row; other columns
of the input are ignored, so their names can't clash; empty tables give an empty result.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import mix64, ship, span_hashes, text_slices, tidied

#: Texts of so many characters are scanned at a time.
SCAN_CHARS = 1 << 19
CHUNK = 256
#: Bytes of a chunk of the second machine, and the bytes before a chunk from which its states of entry are guessed.
BYTES, WARM = 128, 16
#: Remembered pre-tokens (of the packing) and compiled transitions of a worker; beyond, they are forgotten and built again.
CACHE_WORDS, CACHE_STATES = 700_000, 300_000

# States: 0 nothing open, 1 letters, 2 numbers, 3 other signs, 4 a space that joins what follows, 5 white space,
# 6 and 7 one and two letters of a contraction to come.
# Symbols: letter, number, sign, apostrophe before a one- or two-letter contraction, joining space, white space
# before something else, white space before white space or the end, end of a text.
_L, _N, _P, _A1, _A2, _SP, _WL, _W, _R = range(9)
_SEPARATOR = 0x10FFFF


def _machine() -> tuple[np.ndarray, np.ndarray]:
    step, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for sym, state in ((_L, 1), (_N, 2), (_P, 3)):
        step[sym, :] = state
        cut[sym, [state, 4]] = False
    step[_L, 6], step[_L, 7] = 0, 6
    cut[_L, [6, 7]] = False
    for sym, state in ((_A1, 6), (_A2, 7)):
        step[sym, :] = state
        step[sym, [3, 4]] = 3
        cut[sym, [3, 4]] = False
    step[_SP, :] = 4
    step[_WL, :] = 0
    step[_W, :] = 5
    cut[_W, 5] = False
    return step.reshape(-1), cut.reshape(-1)


_STEP, _CUT = _machine()
#: Next state in the low three bits, whether a pre-token begins in the next.
_MOVE = (_STEP | _CUT.astype(np.uint8) << 3).astype(np.uint8)
#: Symbols after which the state is known whatever it was.
_SYNC = np.array([len(set(_STEP[8 * k : 8 * k + 8].tolist())) == 1 for k in range(9)])


def boundaries(symbols: np.ndarray) -> np.ndarray:
    """Whether a new pre-token begins at each symbol."""
    n = len(symbols)
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, _R, np.uint8)
    grid[:n] = symbols
    grid = grid.reshape(rows, CHUNK)
    # A chunk's map from entry to exit state: constant up to its last synchronising symbol, so all states
    # are followed from there on only.
    sync = _SYNC[grid]
    last = np.where(sync.any(axis=1), CHUNK - 1 - sync[:, ::-1].argmax(axis=1), -1)
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    has = last >= 0
    maps[has] = _STEP[8 * grid[has, last[has]]][:, None]
    grid = np.ascontiguousarray(grid.T) * np.uint8(8)
    order = np.argsort(last, kind="stable")
    upto = np.searchsorted(last[order], np.arange(CHUNK))
    for j in range(max(0, int(last.min(initial=CHUNK)) + 1), CHUNK):
        live = order[: upto[j]]
        maps[live] = _STEP[grid[j, live][:, None] + maps[live]]
    # Prefix scan: after the round of a given stride, a map covers twice that many chunks up to its own.
    stride = 1
    while stride < rows:
        late = np.take_along_axis(maps[stride:], maps[:-stride].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:stride], late])
        stride *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, 0]
    marks = np.empty((CHUNK, rows), np.uint8)
    for j, column in enumerate(grid):
        np.take(_MOVE, column + state, out=marks[j], mode="clip")
        state = marks[j] & 7
    return marks.T.reshape(-1)[:n] > 7


class Vocabulary:
    """The tokens and merges of a byte-level BPE file, and its library object for what is rare."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE files without a normaliser are supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        as_bytes = lambda s: bytes(back[c] for c in s)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(self.ids[as_bytes(a)], self.ids[as_bytes(b)]): (r, self.ids[as_bytes(a + b)]) for r, (a, b) in enumerate(pairs)}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.open = {b[:k] for b in self.ids for k in range(1, len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kinds = np.full(0x110000, 255, np.uint8)
        self.kinds[_SEPARATOR] = _R

    def merged(self, word: bytes) -> list[int]:
        """Byte-pair encoding by its definition: the merge of lowest rank first, the leftmost of equals."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        none = (len(self.rank), 0)
        while len(out) > 1:
            (rank, new), i = min((self.rank.get(p, none), i) for i, p in enumerate(zip(out, out[1:])))
            if rank == none[0]:
                break
            out[i : i + 2] = [new]
        return out

    def stands(self, a: int, b: int) -> bool:
        """Whether token a is followed by token b when their bytes are encoded together."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > CACHE_STATES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def classify(self, points: np.ndarray) -> np.ndarray:
        """The class of each character, as the library's own pattern sees it."""
        kinds = self.kinds[points]
        if (new := kinds == 255).any():
            split = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[new]).tolist():
                for kind, mate in ((_L, "a"), (_N, "1"), (_P, "!")):
                    if len(split(mate + chr(c))) == 1:
                        break
                else:
                    kind = _W
                self.kinds[c] = kind
            kinds = self.kinds[points]
        return kinds

    def scan(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(the texts laid end to end, start and end of each pre-token in it, the text that it belongs to)."""
        joined = chr(_SEPARATOR).join(texts) + chr(_SEPARATOR)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.classify(points)
        if joined.count(chr(_SEPARATOR)) > len(texts):  # the separator itself, inside a text: a sign like any unassigned one
            ends = np.cumsum([len(t) + 1 for t in texts]) - 1
            kinds = kinds.copy()
            kinds[points == _SEPARATOR] = _P
            kinds[ends] = _R
        after = np.append(kinds[1:], np.uint8(_R))
        symbols = kinds.copy()
        white = kinds == _W
        last = white & (after != _W) & (after != _R)
        symbols[last] = _WL
        symbols[last & (points == 32)] = _SP
        if len(quotes := np.flatnonzero(points[:-1] == 39)):
            one = points[quotes + 1]
            two = points[np.minimum(quotes + 2, len(points) - 1)]
            symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = _A1
            pair = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            symbols[quotes[pair]] = _A2
        starts = np.flatnonzero(boundaries(symbols))
        ends = np.append(starts[1:], len(points))
        real = kinds[starts] != _R
        owner = np.cumsum(kinds[starts] == _R)[real]
        return joined, starts[real], ends[real], owner, points

    def parts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special strings: (pieces, their text, special ids: -1 for ordinary pieces)."""
        out, owner, special = [], [], []
        for i, t in enumerate(texts):
            for p in self.cut.split(t) if self.cut and self.cut.search(t) else (t,):
                out.append(p)
                owner.append(i)
                special.append(self.special.get(p, -1))
        return out, np.array(owner, np.int64), np.array(special, np.int64)


class TokenFst:
    """The transducer of a vocabulary: reads bytes, adds up the change of the number of tokens. State 0 is the start.

    Transitions lie in a hash table with open addressing: by state and byte, the next state and the change.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple, int] = {}
        self.meaning: list[tuple] = []
        self.size = 0
        self.state((b"", ((0, -1, 0),)))
        self._room(16)

    def state(self, meaning: tuple) -> int:
        if (at := self.known.get(meaning)) is None:
            at = self.known[meaning] = len(self.meaning)
            self.meaning.append(meaning)
        return at

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the number of tokens, worked out from what the state means."""
        suffix, open_at = self.meaning[state]
        suffix += bytes([byte])
        last = change = None
        grown = []
        for length, before, count in open_at:
            piece = suffix[len(suffix) - length - 1 :]
            if last is None and (t := self.v.ids.get(piece)) is not None and (before < 0 or self.v.stands(before, t)):
                last, change = t, count + 1
            if piece in self.v.open:
                grown.append((length + 1, before, count))
        kept = tuple((a, b, c - change) for a, b, c in grown)
        suffix = suffix[len(suffix) - kept[0][0] :] if kept else b""
        return self.state((suffix, (*kept, (0, last, 0)))), change

    def _room(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.next, self.change = np.full(1 << bits, -1), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, nexts: np.ndarray, changes: np.ndarray) -> None:
        """Put distinct new keys into the table."""
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[left]] == keys[left]
            self.next[at[left[won]]], self.change[at[left[won]]] = nexts[left[won]], changes[left[won]]
            left = left[~won]
            at[left] = at[left] + 1 & (1 << self.bits) - 1

    def _compile(self, keys: np.ndarray) -> None:
        made = np.array([self.arc(k >> 8, k & 255) for k in keys.tolist()], np.int64)
        self.size += len(keys)
        if 4 * self.size > len(self.keys):
            used = self.keys >= 0
            old = self.keys[used], self.next[used], self.change[used]
            self._room((4 * self.size).bit_length() + 1)
            self._insert(*old)
        self._insert(keys, made[:, 0], made[:, 1])

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of many states, each with its byte."""
        keys = states << 8 | symbols
        at = self._home(keys)
        off = np.flatnonzero(self.keys[at] != keys)
        while len(off):
            there = self.keys[at[off]]
            if (new := there < 0).any():
                self._compile(np.unique(keys[off[new]]))
                return self.step(states, symbols)
            off = off[there != keys[off]]
            at[off] = at[off] + 1 & (1 << self.bits) - 1
        return self.next[at], self.change[at]


def _entries(fst: TokenFst, grid: np.ndarray, free: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exit state, number of tokens) of the chunks ``free`` in which no pre-token begins. ``out`` has the exits of the others.

    Their maps are kept as (content, entry) pairs, sorted: chunks of the same bytes share them.
    """
    texts, content = np.unique(grid[free], axis=0, return_inverse=True)
    content = content.reshape(-1)
    begins = np.diff(free, prepend=-2) != 1
    given = out[free[begins] - 1]
    links = np.unique(np.stack([content[:-1], content[1:]], axis=1)[~begins[1:]], axis=0).reshape(-1, 2)
    # Guesses: the states that are reached when a token begins at one of the last places before the chunk.
    warm = np.zeros((len(links), WARM), np.int64)
    for back in range(WARM, 0, -1):
        live = warm[:, back - 1 :]
        symbols = np.repeat(texts[links[:, 0], BYTES - back], live.shape[1])
        warm[:, back - 1 :] = fst.step(live.reshape(-1), symbols)[0].reshape(live.shape)
    pairs = exits = emitted = np.zeros(0, np.int64)
    new = np.unique(np.concatenate([content[begins] << 32 | given, (links[:, 1:] << 32 | warm).reshape(-1)]))
    while len(new):
        state, total = new & 0xFFFFFFFF, np.zeros(len(new), np.int64)
        for j in range(BYTES):
            state, change = fst.step(state, texts[new >> 32, j])
            total += change
        pairs, exits, emitted = (np.concatenate(x) for x in ((pairs, new), (exits, state), (emitted, total)))
        order = np.argsort(pairs)
        pairs, exits, emitted = pairs[order], exits[order], emitted[order]
        low = np.searchsorted(pairs, np.arange(len(texts) + 1) << 32)
        size = np.diff(low)[links[:, 0]]
        from_ = np.repeat(low[links[:, 0]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        new = np.setdiff1d(np.repeat(links[:, 1] << 32, size) | exits[from_], pairs)
    # Prefix scan: at each chunk, for each entry of the first chunk of its window, the pair that is met there.
    # After the round of a given stride, a window covers twice that many chunks, but begins no earlier than its pre-token.
    n, widest = len(free), int(np.diff(low).max())
    met = low[content][:, None] + np.minimum(np.arange(widest), np.diff(low)[content][:, None] - 1)
    since = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    stride = 1
    while stride <= since.max():
        late = np.flatnonzero(since >= stride)
        enter = content[late - stride + 1]
        slot = np.searchsorted(pairs, (enter << 32)[:, None] | exits[met[late - stride]]) - low[enter][:, None]
        met[late] = np.take_along_axis(met[late], slot, axis=1)
        stride *= 2
    first = np.flatnonzero(begins)
    slot = np.searchsorted(pairs, content[first] << 32 | given) - low[content[first]]
    at = met[np.arange(n), np.repeat(slot, np.diff(first, append=n))]
    return exits[at], emitted[at]


def tokens_before(fst: TokenFst, data: np.ndarray, fresh: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of tokens before each place; a place is the end or one at which a pre-token begins (``fresh``), as the first byte is."""
    n, rows = len(data), len(data) // BYTES + 1
    grid, reset = np.full(rows * BYTES, 32, np.uint8), np.ones(rows * BYTES, bool)
    grid[:n], reset[:n] = data, fresh
    grid, reset = grid.reshape(rows, BYTES), reset.reshape(rows, BYTES)
    first = np.where(reset.any(axis=1), reset.argmax(axis=1), BYTES)
    # What follows the first beginning of a pre-token in each chunk.
    order = np.argsort(first, kind="stable")
    columns, resets = np.ascontiguousarray(grid[order].T), np.ascontiguousarray(reset[order].T)
    state, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    before = np.zeros((BYTES, rows), np.int16)
    for j, live in enumerate(np.searchsorted(first[order], np.arange(BYTES), side="right").tolist()):
        before[j, :live] = total[:live]
        state[:live], change = fst.step(np.where(resets[j, :live], 0, state[:live]), columns[j, :live])
        total[:live] += change
    out, tail, head = np.empty(rows, np.int64), np.empty(rows, np.int64), np.zeros(rows, np.int64)
    out[order], tail[order] = state, total
    if len(free := np.flatnonzero(first == BYTES)):
        out[free], head[free] = _entries(fst, grid, free, out)
    # What precedes it, from the exit of the chunk before.
    late = np.flatnonzero((first > 0) & (first < BYTES))
    late = late[np.argsort(-first[late], kind="stable")]
    state, columns = out[late - 1], np.ascontiguousarray(grid[late].T)
    for j in range(int(first[late].max(initial=0))):
        live = np.searchsorted(-first[late], -j)
        state[:live], change = fst.step(state[:live], columns[j, :live])
        head[late[:live]] += change
    total = head + tail
    row, column = np.divmod(places, BYTES)
    seat = np.empty(rows, np.int64)
    seat[order] = np.arange(rows)
    return (np.cumsum(total) - total + head)[row] + before[column, seat[row]]


class WordTable:
    """Remembered values of pre-tokens by fingerprint, in two sorted runs."""

    def __init__(self):
        self.old = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.young = self.old

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of sorted keys; -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        for have, values in (self.old, self.young):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit] = values[at[hit]]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        a, b = np.concatenate([self.young[0], keys]), np.concatenate([self.young[1], values])
        order = np.argsort(a)
        self.young = (a[order], b[order])
        if len(a) > 100_000:
            a, b = np.concatenate([self.old[0], self.young[0]]), np.concatenate([self.old[1], self.young[1]])
            order = np.argsort(a, kind="stable")
            self.old, self.young = (a[order], b[order]), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.old[0]) + len(self.young[0])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def machine(path: str) -> TokenFst:
    return TokenFst(vocabulary(path))


def distinct_spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(sorted distinct fingerprints, one place of each, which of them each span has)."""
    prints = span_hashes(mix64(points.astype(np.uint64) + np.uint64(1)), starts, ends)
    return np.unique(prints, return_index=True, return_inverse=True)


def counts(texts: list[str], path: str) -> np.ndarray:
    """Number of tokens of each text."""
    v, fst = vocabulary(path), machine(path)
    pieces, owner, special = v.parts(texts)
    ordinary = np.flatnonzero(special < 0)
    total = np.bincount(owner[special >= 0], minlength=len(texts)).astype(np.int64)
    whole = [pieces[i] for i in ordinary]
    joined, starts, _, _, points = v.scan(whole)
    if len(starts):
        if fst.size > CACHE_STATES:
            fst.clear()
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=place[1:])
        close = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)) + 1) - 1
        fresh = np.zeros(place[-1], bool)
        fresh[place[starts]] = fresh[place[close]] = True
        edges = np.concatenate([place[close], [0], place[close[:-1] + 1]])
        upto, since = tokens_before(fst, np.frombuffer(joined.encode(), np.uint8), fresh, edges).reshape(2, -1)
        total += np.bincount(owner[ordinary], weights=upto - since, minlength=len(texts)).astype(np.int64)
    return total


def resolve(tokenizer: str) -> str:
    """A path as given, or the place of a public tokenizer's file of that name."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row. No shuffle: each row is counted where it is read."""
    ship(docs.sparkSession)
    path = tokenizer

    def run(batches):
        for batch in batches:
            for a, b, column in text_slices(batch.column(1), SCAN_CHARS):
                texts = [x or "" for x in column.to_pylist()]
                n = counts(texts, resolve(path))
                size = np.array([len(t.encode()) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)
