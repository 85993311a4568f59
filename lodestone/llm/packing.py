"""Cost-balanced packing of documents into training sequences.

A document is its token ids and one closing id. Full sequences are cut off first; what remains of the
documents of a block goes, longest first, to the sequence of lowest estimated cost (linear in its tokens
plus quadratic in the length of each piece, as attention is) among those with room for it. A piece that
fits nowhere any more fills the cheapest sequence with room and its rest is placed in turn. The capacities
of a block's sequences add up to its tokens: they are ``width`` tokens, and for the last few hundred tokens
powers of two, so no sequence needs padding.

Blocks are made where rows are read: no shuffle, and a task holds one block of at most ``block_tokens``
(more only for a single longer document). Ids of sequences join the task's partition and a counter, so a
task that runs again makes the same ones.

Edge cases: a null or empty text is the closing id alone; repeated rows are packed as often as they
occur; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import Ragged, ragged_take, ship, text_slices, tidied
from lodestone.llm.fst_tokens import CACHE_WORDS, SCAN_CHARS, WordTable, distinct_spans, resolve, vocabulary

WIDTH = 1024
#: Tokens of a block.
BLOCK_TOKENS = 1 << 20


class IdStore:
    """Token ids of the pre-tokens met so far; a library encodes each distinct one.

    Where the order of the merges is the order of the ids they make, the ids serve as ranks of the faster of
    two libraries, which then gives the same ids; other files go through the tokenizer's own.
    """

    def __init__(self, path: str):
        self.v = vocabulary(path)
        made = [new for _, new in self.v.rank.values()]
        self.piece = None
        if made == sorted(set(made)) and len(made) + 256 == len(self.v.ids):
            import tiktoken

            self.piece = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.v.ids, special_tokens={})._core_bpe.encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.table = WordTable()
        self.lists = Ragged(np.uint32)

    def add(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        if self.piece:
            lists = [self.piece(w.encode()) for w in words]
        else:
            lists = [e.ids for e in self.v.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        names = self.lists.add(flat, sizes)
        self.table.add(keys, names)
        return names

    def encode(self, texts: list[str], last: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``last``; number of ids of each)."""
        pieces, owner, special = self.v.parts(texts)
        ordinary = np.flatnonzero(special < 0)
        joined, starts, ends, piece, points = self.v.scan([pieces[i] for i in ordinary])
        if self.lists.n > CACHE_WORDS:
            self.clear()
        keys, at, which = distinct_spans(points, starts, ends)
        names = self.table.find(keys)
        if len(new := np.flatnonzero(names < 0)):
            names[new] = self.add(keys[new], [joined[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
        # One run of ids per pre-token, special string and end of text, in the order of the texts.
        runs = names[which]
        place, frm, size = owner[ordinary[piece]], self.lists.at[runs], self.lists.length[runs]
        fixed, k = self.lists.flat, self.lists.used
        odd = np.flatnonzero(special >= 0)
        fixed = np.concatenate([fixed[:k], np.append(special[odd], last).astype(np.uint32)])
        step = np.concatenate([2 * ordinary[piece], 2 * odd, 2 * np.searchsorted(owner, np.arange(len(texts)), side="right") - 1])
        order = np.argsort(step, kind="stable")
        place = np.concatenate([place, owner[odd], np.arange(len(texts))])[order]
        frm = np.concatenate([frm, k + np.arange(len(odd)), np.full(len(texts), k + len(odd))])[order]
        size = np.concatenate([size, np.ones(len(odd) + len(texts), np.int64)])[order]
        return ragged_take(fixed, frm, size), np.bincount(place, weights=size, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def store(path: str) -> IdStore:
    return IdStore(path)


def capacities(tokens: int, width: int) -> list[int]:
    """Sequence sizes that add up to the tokens: the width as often as it goes, then powers of two."""
    rest = tokens % width
    return [width] * (tokens // width) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def place(lengths: np.ndarray, width: int, linear: float = 1.0, quadratic: float = 1.0 / WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a block."""
    out, seq = [], 0
    for d, n in enumerate(lengths.tolist()):
        for s in range(0, n - width + 1, width):
            out.append((d, s, width, seq, 0))
            seq += 1
    rest = lengths % width
    room = np.array(capacities(int(rest.sum()), width), np.int64)
    free, cost = room.copy(), np.zeros(len(room))
    todo = [(int(rest[d]), d, int(lengths[d] - rest[d])) for d in np.argsort(-rest, kind="stable") if rest[d]]
    for n, d, s in todo:
        while n:
            fits = np.where(free >= n, cost, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:  # cut: the cheapest sequence with room is filled
                k = int(np.where(free > 0, cost, np.inf).argmin())
            take = min(n, int(free[k]))
            out.append((d, s, take, seq + k, int(room[k] - free[k])))
            free[k] -= take
            cost[k] += linear * take + quadratic * take * take
            n, s = n - take, s + take
    return out


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, last: int = 0, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit, binary)."""
    ship(docs.sparkSession)

    def run(batches):
        base, seqs = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        held: list = []  # [names, ids, lengths] of the block to come
        size = 0

        def block():
            nonlocal seqs, held, size
            names = pa.concat_arrays([x[0] for x in held])
            ids, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            held, size = [], 0
            first = np.cumsum(lengths) - lengths
            rows = np.array(place(lengths, width), np.int64).reshape(-1, 5)
            d, s, n, q, o = rows.T
            raw = ids.astype("<u4").tobytes()
            begin = (4 * (first[d] + s)).tolist()
            pieces = pa.array([raw[b : b + 4 * k] for b, k in zip(begin, n.tolist())], pa.binary())
            out = [names.take(pa.array(d)), pa.array(s), pa.array(n), pa.array(lengths[d]), pa.array(base + seqs + q), pa.array(o), pieces]
            seqs += int(q.max()) + 1 if len(q) else 0
            return pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

        for batch in batches:
            for a, b, column in text_slices(batch.column(1), SCAN_CHARS):
                ids, lengths = store(resolve(tokenizer)).encode([x or "" for x in column.to_pylist()], last)
                held.append((batch.column(0).slice(a, b - a), ids, lengths))
                size += len(ids)
                if size >= block_tokens:
                    yield block()
        if held:
            yield block()

    long = T.LongType()
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, long) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)
