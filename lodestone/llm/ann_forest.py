"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a long string: symbol after symbol, a random rotation and the axis (with its sign)
that the rotated vector lies closest to, a cross-polytope hash. A tree is the sorted array of its strings. A
query descends in every tree to the rows with the longest common prefix; then all trees ascend together, one
symbol at a time, and add the rows below until there are enough candidates (a share of the rows, so that
recall doesn't fall as data grow); at the root all rows are candidates. Candidates are ranked exactly, in double
precision on the vectors as they are.

Rows are dealt to shards of bounded size by a hash of their id, each with its own forest over all its rows;
blocks of queries visit every shard, and the best of each shard are merged. Equal vectors are hashed and
compared once, and so are equal queries; of equal vectors only the k + 1 smallest ids can be among the k nearest, so
a vector that a third of the rows share costs no more than another.

Edge cases: vectors that are null, zero, not of the most common length, or hold null or non-finite components take
no part; fewer candidates than k give all of them; ties go to the smaller id; rows of equal ids are separate: each
distinct vector of a query's id has a list of its own, and none holds that id; rows with a null id take no part;
other columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import mix64, ship, span_hashes, tidied

TREES, SYMBOLS = 56, 6
#: Least candidates as a share of a shard's distinct vectors, and for each neighbour; rows of a shard; queries of a block.
SHARE, FLOOR, SHARD_ROWS, BLOCK = 0.2, 50, 8192, 8192


@lru_cache(maxsize=2)
def rotations(dim: int, trees: int, symbols: int) -> np.ndarray:
    rng = np.random.default_rng(20240611)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0].astype(np.float32) for _ in range(trees * symbols)]).reshape(trees, symbols, dim, dim)


def strings(x: np.ndarray, trees: int, symbols: int) -> np.ndarray:
    """(trees, rows) hash strings, packed with the first symbol highest."""
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    width = max(1, int(2 * x.shape[1] - 1).bit_length())
    symbols = min(symbols, 63 // width)
    out = np.zeros((trees, len(x)), np.int64)
    for t, tree in enumerate(rotations(x.shape[1], trees, symbols)):
        for r in tree:
            y = unit @ r
            axis = np.abs(y).argmax(axis=1)
            out[t] = out[t] << width | axis * 2 + (y[np.arange(len(y)), axis] < 0)
    return out


class Forest:
    """The sorted string arrays of distinct vectors."""

    def __init__(self, x: np.ndarray, trees: int = TREES, symbols: int = SYMBOLS):
        self.x, self.trees = x, trees
        self.width = max(1, int(2 * x.shape[1] - 1).bit_length())
        self.symbols = min(symbols, 63 // self.width)
        s = strings(x, trees, symbols)
        self.order = np.argsort(s, axis=1, kind="stable")
        self.sorted = np.take_along_axis(s, self.order, axis=1)

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, depth 1.., queries) bounds of the rows that share a prefix of each length with a query."""
        s = strings(queries, self.trees, self.symbols)
        low, high = (np.zeros((self.trees, self.symbols, len(queries)), np.int64) for _ in range(2))
        for t in range(self.trees):
            for d in range(self.symbols):
                shift = self.width * (self.symbols - 1 - d)
                prefix = s[t] >> shift
                low[t, d] = np.searchsorted(self.sorted[t], prefix << shift)
                high[t, d] = np.searchsorted(self.sorted[t], (prefix + 1) << shift)
        return low, high

    def candidates(self, queries: np.ndarray, least: int):
        """Places of each query's candidates."""
        low, high = self.ranges(queries)
        mark = np.zeros(len(self.x), bool)
        for q in range(len(queries)):
            some: np.ndarray | None = None
            for d in range(self.symbols - 1, -1, -1):
                if not (high[:, d, q] > low[:, d, q]).any():
                    continue
                for t in np.flatnonzero(high[:, d, q] > low[:, d, q]):
                    mark[self.order[t, low[t, d, q] : high[t, d, q]]] = True
                if np.count_nonzero(mark) >= least:
                    some = np.flatnonzero(mark)
                    break
            mark[:] = False
            yield np.arange(len(self.x)) if some is None else some


def best(ids: list[np.ndarray], x: np.ndarray, forest: Forest, queries: np.ndarray, k: int, share: float):
    """For each query vector the k + 1 best (id, score), ids ascending where scores are equal."""
    least = max(FLOOR * (k + 1), int(share * len(x)))
    for q, some in zip(queries, forest.candidates(queries, least)):
        rough = x[some] @ q
        if len(some) > k + 1:
            bar = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            some = some[rough >= bar - 1e-9 * max(1.0, abs(bar))]
        exact = (x[some] * q).sum(axis=1)
        n = [len(ids[i]) for i in some]
        names, scores = np.concatenate([ids[i] for i in some]), np.repeat(exact, n)
        top = np.lexsort((names, -scores))[: k + 1]
        yield names[top], scores[top]


def search(vectors: DataFrame, mod: int = 20, k: int = 20, trees: int = TREES, symbols: int = SYMBOLS, share: float = SHARE, shard_rows: int = SHARD_ROWS, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row whose id is divisible by ``mod``."""
    spark = vectors.sparkSession
    ship(spark)
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda v: v.cast("double") + 0.0).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    good = good.where(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("v", lambda v: v != 0))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % mod == 0).alias("q")).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    main = max(sizes, key=lambda r: (r["n"], r["d"]))
    good = good.where(F.size("v") == main["d"])
    shards, blocks = -(-main["n"] // shard_rows), max(1, -(-main["q"] // block))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = good.select("id", "v", shard.alias("shard")).withColumn("part", every(blocks)).withColumn("asks", F.lit(0))
    asked = good.where(F.col("id") % mod == 0).select("id", "v", part.alias("part")).withColumn("shard", every(shards)).withColumn("asks", F.lit(1))
    laid = base.select("shard", "part", "asks", "id", "v").unionByName(asked.select("shard", "part", "asks", "id", "v"))
    laid = laid.repartition(shards * blocks, "shard", "part").sortWithinPartitions("shard", "part", "asks")

    def classes(ids, x):
        """Distinct vectors with the ids of each, ascending."""
        _, first, which = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
        order = np.lexsort((ids, which))
        return x[first], np.split(ids[order], np.cumsum(np.bincount(which))[:-1])

    def run(batches):
        now, ids, rows, asks = None, [], [], []

        def flush():
            if not ids or not any(len(a) for a in asks):
                return
            name, x, q = np.concatenate(ids), np.concatenate(rows), np.concatenate(asks).astype(bool)
            if not (~q).any() or not q.any():
                return
            vecs, own = classes(name[~q], x[~q])
            own = [o[: k + 1] for o in own] if k else own
            queries, who = classes(name[q], x[q])
            forest = Forest(vecs, trees, symbols)
            out = []
            marks = span_hashes(mix64(queries.view(np.uint64).reshape(-1) + np.uint64(1)), np.arange(len(queries)) * queries.shape[1], (np.arange(len(queries)) + 1) * queries.shape[1]).view(np.int64)
            for names, mark, (found, score) in zip(who, marks, best(own, vecs, forest, queries, k, share)):
                for n in np.unique(names):
                    keep = found != n
                    out.append((np.full(keep.sum(), n)[:k], np.full(keep.sum(), mark)[:k], found[keep][:k], score[keep][:k]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "mark", "vec_id", "score"])

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * blocks + batch.column(1).to_numpy()
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and key[a] != now:
                    yield from flush()
                    ids, rows, asks = [], [], []
                now = key[a]
                ids.append(batch.column(3).to_numpy()[a:b])
                rows.append(flat[a:b])
                asks.append(batch.column(2).to_numpy()[a:b])
        if now is not None:
            yield from flush()

    found = laid.mapInArrow(tidied(run), "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
