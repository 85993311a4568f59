"""Exact Jaccard self-join of word n-gram sets, by a prefix tree, with the components of its links.

1. Every row's distinct shingles become 64-bit fingerprints; rows with equal sets are one class. Tasks send
   sorted, compressed runs of shortened fingerprints to shards, which report how many shingles of a set occur in
   another set too. A set with too few of them for any partner is done: most of a corpus leaves here.
2. The sets that stay are read again. Shards count the sets that hold each shingle; a set's shingles are put in
   the global order (rarest first, then by fingerprint), and sets that share one of the first n - need + 1 are
   candidates: two sets similar enough must meet there. Sets joined by candidates form a family.
3. Each family is stored in a prefix tree of its sets, in one order for the whole tree (most frequent first, so
   that near copies share long paths). Probes walk the tree level by level, share the overlap of a path among all
   sets below it, and leave subtrees whose remaining lengths can't reach the need. Links are exact. Once all sets
   outside the largest component have been probed, no link between components can be missing, so a family of
   many near copies costs few probes.
4. A family above ``most`` shingles is dealt into blocks that all hold its first set; sets that are not joined to
   it within their block are then probed against the other blocks.

Components come from alternating stars over tables in the shared folder. No pairs within a group are emitted
beyond spanning links, and no fingerprints reach the driver. With ``links``, all sets of a family are probed, and
across its blocks too, and only their numbers of links are kept.

Edge cases: null or empty texts, and texts without a word, have 0 shingles and are a component of their own (their
id; null for a null id); shorter texts than a shingle are one shingle; equal rows are linked; a null id doesn't
become a component's smallest id unless all are null; an empty table gives no row; other columns are ignored.
Sets are told apart by 64-bit fingerprints and their size.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import dealt, mix64, partitions, ragged_take, scan_words, ship, squeeze, stored, text_slices, tidied, unsqueeze, utf8
from lodestone.llm.components import components

SCAN_BYTES = 1 << 19
#: Shingles of a chunk that a task sends at once, and of a block of a family.
CHUNK, MOST = 1_000_000, 500_000
#: Bytes of text whose shingles are counted in one shard.
SHARD_BYTES = 32 << 20
#: Places among which the sets of one key are dealt.
SALTS = 16


def need(n, percent: int):
    """Least overlap that a set of n has with any partner."""
    return -(-n * percent // 100)


def linked(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle fingerprints of each text, one after the other; how many each has)."""
    _, _, _, words, counts = scan_words(texts)
    first = np.cumsum(counts) - counts
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owner = np.repeat(np.arange(len(texts)), many)
    size = np.minimum(counts, k)[owner]
    keys = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            inside = i < size
            keys[inside] = mix64(keys[inside] * np.uint64(0x9FB21C651E98DF25) + words[at[inside] + i])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.bincount(owner[new], minlength=len(texts)).astype(np.int64)


def set_names(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each set."""
    run = np.zeros(len(keys) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(keys ^ np.uint64(0x5851F42D4C957F2D)), out=run[1:])
        ends = np.cumsum(sizes)
        return mix64(run[ends] - run[ends - sizes] + sizes.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def _rises(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.zeros(1, a.dtype))


@lru_cache(maxsize=4)
def _edges(bits: int, shards: int) -> np.ndarray:
    return np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)


def _routed(keys: np.ndarray, owner: np.ndarray, bits: int, shards: int):
    """(shard, sorted keys, their owners) of each shard that has some; shards are ranges of keys of so many bits."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    cuts = np.concatenate([[0], np.searchsorted(keys, _edges(bits, shards)), [len(keys)]])
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, keys[cuts[s] : cuts[s + 1]], owner[cuts[s] : cuts[s + 1]]


def _chunk_rows(names: list[np.ndarray], keys: list[np.ndarray], sizes: list[np.ndarray], bits: int, shards: int):
    """(shard, chunk, kind, blob, blob) rows of the distinct sets of a chunk. Kind 0: keys and owners; 1: names and sizes."""
    names, keys, sizes = np.concatenate(names), np.concatenate(keys), np.concatenate(sizes)
    names, first = np.unique(names, return_index=True)
    at = (np.cumsum(sizes) - sizes)[first]
    sizes = sizes[first]
    keys = ragged_take(keys, at, sizes) >> np.uint64(64 - bits)
    owner = np.repeat(np.arange(len(names), dtype=np.uint32), sizes)
    # Equal chunks of different tasks are told apart, and a task that runs again gives its chunks the same names.
    place = (TaskContext.get().partitionId() if TaskContext.get() else 0).to_bytes(8, "little")
    chunk = int.from_bytes(hashlib.blake2b(names.tobytes() + place, digest_size=8).digest(), "little", signed=True)
    yield chunk % shards, chunk, 1, squeeze(names), squeeze(sizes)
    for s, k, o in _routed(keys, owner, bits, shards):
        yield s, chunk, 0, squeeze(_rises(k)), squeeze(o)


_CHUNKED = [T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("b1", T.BinaryType()), T.StructField("b2", T.BinaryType())]


def _batch(rows, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), target)], schema=target)


def _counted(blobs: list[tuple[int, bytes, bytes]]):
    """For the runs of one shard: (chunk, keys, owners, number of sets that hold each key)."""
    runs = [(c, np.cumsum(unsqueeze(k, np.uint64)), unsqueeze(o, np.uint32)) for c, k, o in blobs]
    keys = np.concatenate([r[1] for r in runs])
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    at = 0
    for c, k, o in runs:
        yield c, k, o, count[which[at : at + len(k)]]
        at += len(k)


def _by_shard(batches, passed):
    """Rows of kind 0 gathered by shard; ``passed`` gets the rest of each batch."""
    shards: dict[int, list] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        if len(rest := np.flatnonzero(kind != 0)):
            yield from passed(batch.take(pa.array(rest)))
        own = batch.take(pa.array(np.flatnonzero(kind == 0)))
        for s, c, a, b in zip(own.column("shard").to_pylist(), own.column("chunk").to_pylist(), own.column("b1").to_pylist(), own.column("b2").to_pylist()):
            shards.setdefault(s, []).append((c, a, b))
    yield shards


def _sets(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, shards: int) -> tuple[DataFrame, DataFrame]:
    """((id, set_id, n) of every row; (set_id) of the sets that may have a partner)."""
    bits = min(64, 31 + shards.bit_length())
    schema = T.StructType([*_CHUNKED, T.StructField("id", docs.schema[id_col].dataType), T.StructField("set_id", T.LongType()), T.StructField("n", T.LongType())])

    def read(batches):
        held, size = ([], [], []), 0
        for batch in batches:
            for a, b, column in text_slices(batch.column(1), SCAN_BYTES):
                keys, sizes = shingles(utf8(column), k)
                names = set_names(keys, sizes)
                none, m = pa.nulls(b - a, pa.binary()), b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((np.arange(m) + len(keys)) % shards).astype(np.int32)), pa.array(names), pa.array(np.full(m, 2, np.int32)), none, none, batch.column(0).slice(a, m), pa.array(names), pa.array(sizes)], names=schema.names
                )
                some = sizes > 0
                for h, x in zip(held, (names[some], keys, sizes[some])):
                    h.append(x)
                size += len(keys)
                if size >= CHUNK:
                    yield _batch([(*r, None, None, None) for r in _chunk_rows(*held, bits, shards)], schema)
                    held, size = ([], [], []), 0
        if size:
            yield _batch([(*r, None, None, None) for r in _chunk_rows(*held, bits, shards)], schema)

    def shared(batches):
        for x in _by_shard(batches, lambda rest: [rest]):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            for s, blobs in x.items():
                out = [(s, c, 0, squeeze(np.bincount(o[n > 1], minlength=int(o.max()) + 1).astype(np.uint32)), None, None, None, None) for c, _, o, n in _counted(blobs)]
                yield _batch(out, schema)

    sent = docs.select(id_col, text_col).mapInArrow(tidied(read), schema)
    back = stored(dealt(sent, shards, F.col("shard")).mapInArrow(tidied(shared), schema), "shared")

    def active(batches):
        sums: dict[int, np.ndarray] = {}
        lists: dict[int, tuple] = {}
        for batch in batches:
            for c, kind, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind:
                    lists[c] = (unsqueeze(a, np.int64), unsqueeze(b, np.int64))
                else:
                    x = unsqueeze(a, np.uint32).astype(np.int64)
                    have = sums.get(c, np.zeros(0, np.int64))
                    total = np.zeros(max(len(x), len(have)), np.int64)
                    total[: len(x)] += x
                    total[: len(have)] += have
                    sums[c] = total
        for c, (names, sizes) in lists.items():
            total = np.zeros(len(names), np.int64)
            got = sums.get(c, total[:0])
            total[: len(got)] = got
            yield pa.RecordBatch.from_arrays([pa.array(names[total >= need(sizes, percent)])], names=["set_id"])

    chunks = back.where("kind < 2").select("chunk", "kind", "b1", "b2")
    return back.where("kind = 2").select("id", "set_id", "n"), chunks.repartition(shards, "chunk").mapInArrow(tidied(active), "set_id long").distinct()


def _candidates(texts: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """(a, b): each set with the smallest set that shares one of its first shingles in the global order."""
    schema = T.StructType(_CHUNKED)

    def read(batches):
        held, size = ([], [], []), 0
        for batch in batches:
            for _, _, column in text_slices(batch.column(1), SCAN_BYTES):
                keys, sizes = shingles(utf8(column), k)
                for h, x in zip(held, (set_names(keys, sizes), keys, sizes)):
                    h.append(x)
                size += len(keys)
                if size >= CHUNK:
                    yield _batch(list(_chunk_rows(*held, 64, shards)), schema)
                    held, size = ([], [], []), 0
        if size:
            yield _batch(list(_chunk_rows(*held, 64, shards)), schema)

    def count(batches):
        for x in _by_shard(batches, lambda rest: [rest.append_column("b3", pa.nulls(len(rest), pa.binary()))]):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            for s, blobs in x.items():
                yield _batch([(s, c, 0, squeeze(_rises(keys)), squeeze(o), squeeze(n.astype(np.uint32))) for c, keys, o, n in _counted(blobs)], counted)

    def prefixes(batches):
        runs: dict[int, list] = {}
        lists: dict[int, tuple] = {}
        for batch in batches:
            for c, kind, a, b, d in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if kind:
                    lists[c] = (unsqueeze(a, np.int64), unsqueeze(b, np.int64))
                else:
                    runs.setdefault(c, []).append((a, b, d))
        for c, (names, sizes) in lists.items():
            keys = np.concatenate([np.cumsum(unsqueeze(r[0], np.uint64)) for r in runs[c]])
            owner = np.concatenate([unsqueeze(r[1], np.uint32) for r in runs[c]]).astype(np.int64)
            df = np.concatenate([unsqueeze(r[2], np.uint32) for r in runs[c]])
            order = np.lexsort((keys, df, owner))
            keys, owner, df = keys[order], owner[order], df[order]
            rank = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            take = (rank <= (sizes - need(sizes, percent))[owner]) & (df > 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys[take].view(np.int64)), pa.array(names[owner[take]])], names=["key", "set_id"])

    counted = T.StructType([*_CHUNKED, T.StructField("b3", T.BinaryType())])
    back = dealt(texts.select("set_id", "text").mapInArrow(tidied(read), schema), shards, F.col("shard")).mapInArrow(tidied(count), counted)
    first = stored(back.select("chunk", "kind", "b1", "b2", "b3").repartition(shards, "chunk").mapInArrow(tidied(prefixes), "key long, set_id long"), "prefixes")
    least = first.groupBy("key").agg(F.min("set_id").alias("b"), F.max("set_id").alias("top")).where("b < top").drop("top")
    # A key that very many sets hold meets its least set in SALTS places.
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = first.withColumn("salt", F.pmod(F.xxhash64("set_id", F.lit(5)), F.lit(SALTS)).cast("int"))
    return first.join(least, ["key", "salt"]).select(F.col("set_id").alias("a"), "b").where("a <> b").distinct()


class PrefixTree:
    """Sets of small integers, each sorted, in a path-compressed tree."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        order = sorted(range(len(sets)), key=[s.astype(">u4").tobytes() for s in sets].__getitem__)
        parent, depth, upto, leaf = [-1], [0], [0], [-1]  # nodes: parent, depth above it, depth of its end, its set
        source = [order[0] if order else 0]
        stack, last = [0], None
        for i in order:
            s = sets[i]
            if last is not None:
                n = min(len(s), len(last))
                differ = np.flatnonzero(s[:n] != last[:n])
                common = int(differ[0]) if len(differ) else n
                child = None
                while upto[stack[-1]] > common:
                    child = stack.pop()
                if upto[stack[-1]] < common:  # split the edge to the child that was left
                    parent.append(stack[-1])
                    depth.append(upto[stack[-1]])
                    upto.append(common)
                    leaf.append(-1)
                    source.append(source[child])
                    parent[child], depth[child] = len(parent) - 1, common
                    stack.append(len(parent) - 1)
            parent.append(stack[-1])
            depth.append(upto[stack[-1]])
            upto.append(len(s))
            leaf.append(i)
            source.append(i)
            if len(s) > upto[stack[-1]]:
                stack.append(len(parent) - 1)
            last = s
        self.parent, self.upto, self.leaf = np.array(parent), np.array(upto, np.int64), np.array(leaf)
        depth = np.array(depth, np.int64)
        runs = [sets[source[v]][depth[v] : self.upto[v]] if v else np.zeros(0, np.int64) for v in range(len(parent))]
        self.length = np.array([len(r) for r in runs], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.tokens = np.concatenate(runs).astype(np.int64) if runs else np.zeros(0, np.int64)
        self.last = np.array([r[-1] if len(r) else -1 for r in runs], np.int64)
        kids = np.argsort(self.parent, kind="stable")[1:]
        self.kids = kids
        self.kid_count = np.bincount(self.parent[kids], minlength=len(parent))
        self.kid_at = np.cumsum(self.kid_count) - self.kid_count
        low = np.where(self.leaf >= 0, self.sizes[self.leaf] if len(self.sizes) else 0, 1 << 60)
        high = np.where(self.leaf >= 0, self.sizes[self.leaf] if len(self.sizes) else 0, 0)
        self.levels = []
        level = np.array([0])
        while len(level):
            self.levels.append(level)
            level = ragged_take(self.kids, self.kid_at[level], self.kid_count[level])
        for level in reversed(self.levels[1:]):
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        self.low, self.high = low, high

    def probe(self, xs: list[np.ndarray], vocabulary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set) of all links of the probes, which walk the tree together."""
        n = np.array([len(x) for x in xs], np.int64)
        first = np.cumsum(n) - n
        flat = np.concatenate(xs).astype(np.int64) + np.repeat(np.arange(len(xs)) * vocabulary, n)
        mark = np.zeros(len(xs) * vocabulary, np.int8)
        mark[flat] = 1
        least = need(n, percent)
        who, level, overlap = np.arange(len(xs)), np.zeros(len(xs), np.int64), np.zeros(len(xs), np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(level):
            count = self.kid_count[level]
            overlap, who = np.repeat(overlap, count), np.repeat(who, count)
            level = ragged_take(self.kids, self.kid_at[level], count)
            # Lengths first: subtrees with only sets too small or too large need no look at their tokens.
            fits = (self.high[level] >= least[who]) & (percent * self.low[level] <= 100 * n[who])
            level, overlap, who = level[fits], overlap[fits], who[fits]
            size = self.length[level]
            hits = mark[ragged_take(self.tokens, self.start[level], size) + np.repeat(who * vocabulary, size)]
            ends = np.cumsum(np.concatenate([[0], hits]))
            upto = np.cumsum(size)
            overlap = overlap + ends[upto] - ends[upto - size]
            done = np.flatnonzero(self.leaf[level] >= 0)
            sets = self.leaf[level[done]]
            good = linked(overlap[done], n[who[done]], self.sizes[sets], percent)
            found.append((who[done[good]], sets[good]))
            more = self.kid_count[level] > 0
            level, overlap, who = level[more], overlap[more], who[more]
            passed = np.searchsorted(flat, self.last[level] + who * vocabulary, side="right") - first[who]
            rest = np.minimum(self.high[level] - self.upto[level], n[who] - passed)
            wanted = -(-percent * (n[who] + np.maximum(self.low[level], least[who])) // (100 + percent))
            alive = overlap + rest >= wanted
            level, overlap, who = level[alive], overlap[alive], who[alive]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def probes(self, xs: list[np.ndarray], vocabulary: int, percent: int):
        """Links of many probes, some at a time: the scratch tables stay below 16 MB."""
        step = max(1, min(64, 16_000_000 // max(1, vocabulary)))
        for at in range(0, len(xs), step):
            who, sets = self.probe(xs[at : at + step], vocabulary, percent)
            yield who + at, sets


def ordered(keys: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Sets as sorted small integers: the most frequent shingle of the family is 0, equals by fingerprint."""
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    token = rank[which]
    token = token[np.lexsort((token, owner))]
    return np.split(token, np.cumsum(sizes)[:-1]), len(count)


def join_family(names: np.ndarray, keys: np.ndarray, sizes: np.ndarray, percent: int, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the smallest name of each set's component within the family, how many rows of other sets each set is linked to: 0 without ``copies``, the rows of each set)."""
    sets, vocabulary = ordered(keys, sizes)
    tree = PrefixTree(sets)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(some: list[int]) -> None:
        for who, others in tree.probes([sets[i] for i in some], vocabulary, percent):
            for i, j in zip(who.tolist(), others.tolist()):
                a, b = find(some[i]), find(j)
                if a != b:
                    root[a if names[a] > names[b] else b] = a if names[a] <= names[b] else b

    hubs = sorted({int(names.argmin()), int(np.argsort(sizes, kind="stable")[len(sizes) // 2])})
    link(hubs)
    main = np.bincount([find(i) for i in range(len(sets))]).argmax()
    link([i for i in range(len(sets)) if i not in hubs and find(i) != main])
    n_links = np.zeros(len(sets), np.int64)
    if copies is not None:
        for who, others in tree.probes(sets, vocabulary, percent):
            np.add.at(n_links, who, np.where(who == others, 0, copies[others]))
    return names[[find(i) for i in range(len(sets))]], n_links


def _grouped(batches, keys: int):
    """Consecutive rows with equal first columns, as lists of column lists."""
    held, now = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if row[:keys] != now:
                if held:
                    yield now, held
                held, now = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield now, held


def _read_sets(rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, fingerprints, sizes and numbers of rows of the distinct sets of (wanted name, rows, text) rows."""
    seen = {}
    for name, copies, text in rows:
        seen.setdefault(name, (copies, text))
    keys, sizes = shingles([(t or "").encode() for _, t in seen.values()], k)
    return np.array(list(seen), np.int64), keys, sizes, np.array([c for c, _ in seen.values()], np.int64)


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, links: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_shingles, component_id): components of links between rows whose sets of k-word shingles have a Jaccard similarity of at least ``percent``.

    With ``links`` also n_links: the number of other rows that each row is linked to. Every set that may have a partner
    is then probed against all sets of its family; no pairs are emitted.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // shard_bytes))
    rows, active = _sets(docs, k, percent, id_col, text_col, shards)
    # One row of the input stands for each set that may have a partner; its text is read again.
    firsts = stored(rows.groupBy("set_id").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count("*").alias("copies")), "sets")
    chosen = firsts.join(active, "set_id").select("set_id", "id")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = chosen.withColumnRenamed("id", "wanted").hint("shuffle_hash")
    own = own.join(wanted, own["id"].eqNullSafe(wanted["wanted"])).select("set_id", "text")

    def right(batches):  # ids may repeat: only the row whose set was chosen counts
        for batch in batches:
            for a, b, column in text_slices(batch.column(1), SCAN_BYTES):
                same = set_names(*shingles(utf8(column), k)) == batch.column(0).slice(a, b - a).to_numpy()
                yield batch.slice(a, b - a).filter(pa.array(same))

    texts = stored(own.mapInArrow(tidied(right), "set_id long, text string"), "texts")
    families = components(_candidates(texts, k, percent, shards))
    sizes = firsts.select("set_id", "n", "copies")
    member = families.select(F.col("u").alias("set_id"), F.col("v").alias("family")).union(families.select("v", "v").distinct()).join(sizes, "set_id")
    blocks = member.groupBy("family").agg(F.ceil(F.sum("n") / most).alias("blocks"))
    dealt = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    spread = F.when(F.col("set_id") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(dealt))
    member = stored(member.join(blocks, "family").select("set_id", "copies", "family", "blocks", F.explode(spread).alias("block")), "members")

    def within(batches):
        for (family, block, blocks_), held in _grouped(batches, 3):
            names, keys, n, copies = _read_sets(held, k)
            out, n_links = join_family(names, keys, n, percent, copies if links else None)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), family)), pa.array(np.full(len(names), block)), pa.array(np.full(len(names), blocks_)), pa.array(out), pa.array(copies), pa.array(n_links)], names=["set_id", "family", "block", "blocks", "label", "copies", "n_links"])

    with_text = member.join(texts, "set_id")
    laid = with_text.select("family", "block", "blocks", "set_id", "copies", "text").repartition(shards, "family", "block").sortWithinPartitions("family", "block")
    label = stored(laid.mapInArrow(tidied(within), "set_id long, family long, block long, blocks long, label long, copies long, n_links long"), "labels")
    edges = label.select(F.col("set_id").alias("a"), F.col("label").alias("b"))
    large = label.where("blocks > 1")
    split = bool(large.limit(1).count())
    if split:
        edges = edges.union(_across(large, texts, k, percent, shards, most))
        roots = components(edges).select(F.col("u").alias("set_id"), F.col("v").alias("label"))
    else:  # every family was joined whole
        roots = label.where("label <> set_id").select("set_id", "label")
    classes = firsts.where("n > 0").join(roots, "set_id", "left").select("set_id", F.col("id").alias("least"), F.coalesce("label", "set_id").alias("label"))
    lowest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(lowest, "label").select("set_id", "component_id")
    out = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")]
    if not links:
        return rows.join(named, "set_id", "left").select(*out)
    others = label.select("set_id", "n_links")
    if split:
        others = others.union(_links_across(large, texts, k, percent, shards))
    others = others.groupBy("set_id").agg(F.sum("n_links").alias("others"))
    named = classes.join(lowest, "label").join(firsts.select("set_id", "copies"), "set_id").join(others, "set_id", "left")
    named = named.select("set_id", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(named, "set_id", "left").select(*out, F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def _across(label: DataFrame, texts: DataFrame, k: int, percent: int, shards: int, most: int) -> DataFrame:
    """Links (a, b) between blocks of large families: sets not joined to the family's first set, against the other blocks."""
    rest = label.where("label <> family")
    groups = rest.groupBy("family").agg(F.ceil(F.count("*") / 2000).alias("parts"))
    probes = rest.join(groups, "family").withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("parts")))
    probes = probes.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block")
    probes = probes.select("family", F.col("to").alias("block"), "part", F.lit(1).alias("probe"), "set_id", "copies")
    kept = label.join(groups, "family").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kept = kept.select("family", "block", "part", F.lit(0).alias("probe"), "set_id", "copies")

    def cross(batches):
        for _, held in _grouped(batches, 3):
            stored_rows = [r[1:] for r in held if not r[0]]
            probe_rows = [r[1:] for r in held if r[0]]
            if not stored_rows or not probe_rows:
                continue
            names, keys, n, _ = _read_sets(stored_rows, k)
            others, more, m, _ = _read_sets(probe_rows, k)
            sets, vocabulary = ordered(np.concatenate([keys, more]), np.concatenate([n, m]))
            for who, found in PrefixTree(sets[: len(n)]).probes(sets[len(n) :], vocabulary, percent):
                yield pa.RecordBatch.from_arrays([pa.array(others[who]), pa.array(names[found])], names=["a", "b"])

    laid = probes.unionByName(kept).join(texts, "set_id").select("family", "block", "part", "probe", "set_id", "copies", "text")
    return laid.repartition(shards, "family", "block", "part").sortWithinPartitions("family", "block", "part").mapInArrow(tidied(cross), "a long, b long")


def _links_across(label: DataFrame, texts: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """(set_id, n_links) between blocks of large families: each set but the first, which all blocks hold, against the sets of the later blocks; a link counts for both its ends."""
    own = label.where("set_id <> family").select("family", "block", "blocks", "set_id", "copies")
    probes = own.select("family", "set_id", "copies", F.lit(1).alias("probe"), F.col("block").alias("from"), F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b > block)")).alias("to"))
    kept = own.select("family", "set_id", "copies", F.lit(0).alias("probe"), F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b < block)")).alias("from"), F.col("block").alias("to"))

    def cross(batches):
        for _, held in _grouped(batches, 3):
            stored_rows = [r[1:] for r in held if not r[0]]
            probe_rows = [r[1:] for r in held if r[0]]
            if not stored_rows or not probe_rows:
                continue
            names, keys, n, copies = _read_sets(stored_rows, k)
            others, more, m, rows = _read_sets(probe_rows, k)
            sets, vocabulary = ordered(np.concatenate([keys, more]), np.concatenate([n, m]))
            left, right = np.zeros(len(others), np.int64), np.zeros(len(names), np.int64)
            for who, found in PrefixTree(sets[: len(n)]).probes(sets[len(n) :], vocabulary, percent):
                np.add.at(left, who, copies[found])
                np.add.at(right, found, rows[who])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([others, names])), pa.array(np.concatenate([left, right]))], names=["set_id", "n_links"])

    laid = probes.unionByName(kept).join(texts, "set_id").select("family", "from", "to", "probe", "set_id", "copies", "text")
    return laid.repartition(shards, "family", "from", "to").sortWithinPartitions("family", "from", "to").mapInArrow(tidied(cross), "set_id long, n_links long")
