"""Ranked lexical search over documents reordered by recursive graph bisection, in clusters visited by their bounds.

1. One pass cuts every whole text into terms and keeps, of those that the queries hold, each with its count. The
   numbers of documents, of terms and of documents for each term come from this table.
2. Recursive graph bisection is fitted on a bounded sample (``SAMPLE`` documents of the smallest hashes, at most
   ``SAMPLE_BYTES``): a set of documents is halved, and pairs trade places while that lowers the summed logarithmic
   gaps of the terms' lists, then each half is halved in turn. What a term adds to the cost of either half is kept for
   every node. All documents then go down the tree by the lower cost: the leaves are the clusters, in the order of
   the tree, and a document's new place is (cluster, shard, place in the shard).
3. The index has a row for each shard: the postings of its documents by term, each with the term's part of the
   score, the greatest part of each term, and the documents' ids in order of id, which bring places back to ids. A
   cluster that holds many documents is dealt into shards of about ``SHARD`` documents.
4. A cluster's bound for a query is the largest bound of its shards: what its terms' greatest parts would add up to. Each
   query visits its clusters in order of bound, in rounds of growing size. After each round the score of its k-th
   document is its threshold; a cluster whose bound is below it can't hold a better or equal document and is never
   read, and a query is done when no cluster is left. Equal bounds are visited, so that ties go by id. Within a
   cluster, shards are passed over by the same rule.

Queries are taken in blocks of bounded bytes and number, so what goes to the driver (a block's texts, its bounds by
cluster and thresholds, the sample) is bounded by parameters; all else stays in tables. Results are exact.

Edge cases: a null or empty text has no terms, is no document of the statistics and is never found; an item without
terms has no row; items with equal terms are searched once, and each row of the items gets its own list, also where ids
repeat; rows with equal ids are separate documents, null ids sort last; fewer documents with a score than k give all of
them; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import LOWER, partitions, ragged_take, ship, squeeze, stored, text_slices, tidied, unsqueeze, utf8

SAMPLE, SAMPLE_BYTES, LEAF_SAMPLE, DEPTH = 8192, 16 << 20, 64, 8
#: Cells of the tree's table of costs (nodes by terms), documents of a shard, bytes and items of a block of queries.
CELLS, SHARD, BLOCK_BYTES, BLOCK_ITEMS = 16_000_000, 8192, 8 << 20, 10_000
SCAN_BYTES, FIRST, GROWTH = 1 << 20, 2, 4
#: A-Z become small, and all of ASCII but letters and digits ends a term.
_CUT = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_CUT).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, terms, counts) of each text with a term: how many it has, and those of the vocabulary, packed."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def read(batches):
        for batch in batches:
            for a, b, column in text_slices(batch.column(2), SCAN_BYTES):
                sizes, own, counts = [], [], []
                for text in utf8(column):
                    found = terms(text)
                    held = sorted((vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary)
                    sizes.append(len(found))
                    own.append(np.array([t for t, _ in held], np.uint32).tobytes())
                    counts.append(np.array([c for _, c in held], np.uint32).tobytes())
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(own, pa.binary()), pa.array(counts, pa.binary())], names=schema.names)
                yield out.filter(pa.array(np.array(sizes) > 0))

    return docs.select(F.monotonically_increasing_id().alias("row"), id_col, text_col).mapInArrow(tidied(read), schema)


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a column of packed lists, how many each has)."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64), np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))


def holders(vecs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0))[0], minlength=size)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for r in vecs.select("terms").mapInArrow(tidied(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


# ---------------------------------------------------------------- graph bisection


def _cost(d: np.ndarray, n: int) -> np.ndarray:
    """Summed logarithm of the gaps of a list of d among n documents, about."""
    return d * np.log2(max(n, 1) / (d + 1.0))


def _doc_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return run[ends] - run[ends - sizes]


def bisection(flat: np.ndarray, sizes: np.ndarray, size: int, depth: int, rounds: int = 20) -> np.ndarray:
    """(2^depth - 1 nodes, terms): what each term of a document adds to the cost of the left half, less that of the right, at each node in heap order."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(((1 << depth) - 1, size), np.float32)

    def halve(node: int, members: np.ndarray) -> None:
        if node >= len(out) or len(members) < 2:
            return
        own, n = ragged_take(flat, starts[members], sizes[members]), sizes[members]
        left = np.arange(len(members)) < len(members) // 2
        n_left, n_right = int(left.sum()), int((~left).sum())
        for _ in range(rounds):
            in_left = np.repeat(left, n)
            d, e = np.bincount(own[in_left], minlength=size), np.bincount(own[~in_left], minlength=size)
            now = _cost(d, n_left) + _cost(e, n_right)
            there = now - _cost(np.maximum(d - 1, 0), n_left) - _cost(e + 1, n_right)
            back = now - _cost(d + 1, n_left) - _cost(np.maximum(e - 1, 0), n_right)
            gain = _doc_sums(np.where(in_left, there[own], back[own]), n)
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            m = min(len(a), len(b))
            trade = gain[a[:m]] + gain[b[:m]] > 1e-9
            if not trade.any():
                break
            left[a[:m][trade]], left[b[:m][trade]] = False, True
        in_left = np.repeat(left, n)
        d, e = np.bincount(own[in_left], minlength=size), np.bincount(own[~in_left], minlength=size)
        out[node] = _cost(d + 1, n_left) - _cost(d, n_left) - _cost(e + 1, n_right) + _cost(e, n_right)
        halve(2 * node + 1, members[left])
        halve(2 * node + 2, members[~left])

    halve(0, np.arange(len(sizes)))
    return out


def leaves(flat: np.ndarray, sizes: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The leaf that each document comes to, in the order of the tree."""
    at, owner = np.zeros(len(sizes), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    for _ in range((len(tree) + 1).bit_length() - 1):
        at = 2 * at + 1 + (np.bincount(owner, weights=tree[at[owner], flat], minlength=len(sizes)) > 0)
    return at - len(tree)


def fitted(vecs: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """The tree of costs, from a sample of at most ``SAMPLE`` documents and ``SAMPLE_BYTES``: those of the smallest hashes, whatever their number."""
    mark = F.xxhash64("row", "n", "terms")
    share = min(1.0, (SAMPLE + 4 * SAMPLE**0.5 + 10) / n_docs)
    near = vecs.select("terms", mark.alias("mark")).where(F.col("mark") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    below = F.sum(F.length("terms")).over(Window.orderBy("mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sample = [r["terms"] for r in near.orderBy("mark").limit(SAMPLE).withColumn("below", below).where(F.col("below") <= SAMPLE_BYTES).collect()]
    depth = max(0, min(DEPTH, (len(sample) // LEAF_SAMPLE).bit_length() - 1, (CELLS // size).bit_length() - 1))
    flat, sizes = _unpacked(pa.array(sample, pa.binary()))
    return bisection(flat, sizes, size, depth)


# ---------------------------------------------------------------- clustered index

_INDEX = [T.StructField("leaf", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("terms", "tops", "lengths", "places", "parts"))]


def index(vecs: DataFrame, tree: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each shard, in folders by cluster: (leaf, terms, tops, lengths, places, parts, ids). ``terms`` are those that occur, ``tops`` their
    greatest parts, ``lengths`` their numbers of postings; ``places`` and ``parts`` the postings, term by term."""
    spark = vecs.sparkSession

    def place(batches):
        for batch in batches:
            flat, sizes = _unpacked(batch.column(3))
            yield batch.append_column("leaf", pa.array(leaves(flat, sizes, tree).astype(np.int32))).filter(pa.array(sizes > 0))

    routed = stored(vecs.mapInArrow(tidied(place), T.StructType([*vecs.schema.fields, T.StructField("leaf", T.IntegerType())])), "routed")
    counts = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most 2^DEPTH rows
    chunks = F.element_at(F.array(*(F.lit(-(-counts.get(i, 1) // SHARD)) for i in range(len(tree) + 1))), F.col("leaf") + 1)
    routed = routed.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks).cast("int"))
    schema = T.StructType([*_INDEX, T.StructField("ids", T.ArrayType(vecs.schema["id"].dataType))])

    def shard(leaf, rows):
        flat, sizes = _unpacked(rows.column("terms"))
        tf, _ = _unpacked(rows.column("counts"))
        n = np.repeat(rows.column("n").to_numpy(), sizes)
        m = 75 + 25 * n * n_docs // n_terms
        parts = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        places = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(flat, kind="stable")
        own, first, lengths = np.unique(flat[order], return_index=True, return_counts=True)
        packed = (own.astype(np.uint32), np.maximum.reduceat(parts[order], first).astype(np.int32), lengths.astype(np.int32), places[order].astype(np.uint32), parts[order].astype(np.int32))
        ids = rows.column("id").combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), *(pa.array([squeeze(x)], pa.binary()) for x in packed), lists], names=schema.names)

    def build(batches):
        held, now = [], None
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if held and key[a] != now:
                        yield shard(now >> 32, pa.Table.from_batches(held))
                        held = []
                    now = int(key[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield shard(now >> 32, pa.Table.from_batches(held))

    laid = routed.select("leaf", "chunk", "id", "n", "terms", "counts").repartition(partitions(spark), "leaf", "chunk").sortWithinPartitions("leaf", "chunk", F.col("id").asc_nulls_last())
    return stored(laid.mapInArrow(tidied(build), schema), "shards", by="leaf")


def cluster_bounds(idx: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], size: int, n_leaves: int) -> np.ndarray:
    """(queries, clusters): the largest bound of a cluster's shards, from the greatest parts alone."""

    def find(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for leaf, own, tops in zip(*(c.to_pylist() for c in batch.columns)):
                table = _tops(unsqueeze(own, np.uint32), unsqueeze(tops, np.int32), size)
                best[leaf] = np.maximum(best.get(leaf, 0), _bounds(table, queries))
        for leaf, b in best.items():
            own = np.flatnonzero(b)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), leaf)), pa.array(b[own])], names=["q", "leaf", "bound"])

    out = np.zeros((len(queries), n_leaves), np.int64)
    for r in idx.select("leaf", "terms", "tops").mapInArrow(tidied(find), "q long, leaf long, bound long").groupBy("q", "leaf").agg(F.max("bound").alias("bound")).toLocalIterator():
        out[r["q"], r["leaf"]] = r["bound"]
    return out


def _tops(own: np.ndarray, tops: np.ndarray, size: int) -> np.ndarray:
    table = np.zeros(size, np.int64)
    table[own] = tops
    return table


def _bounds(tops: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.fromiter((int(tops[t] @ w) for t, w in queries), np.int64, len(queries))


def best_places(scores: np.ndarray, least: int, k: int) -> np.ndarray:
    """The places of the k highest scores that are at least ``least``, the first of equal ones."""
    own = np.flatnonzero(scores >= least)
    if len(own) > k:
        edge = np.partition(scores[own], len(own) - k)[len(own) - k]
        above = own[scores[own] > edge]
        own = np.concatenate([above, own[scores[own] == edge][: k - len(above)]])
    return own


def visit(idx: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], size: int, wanted: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(q, id, score): each task's best documents of the clusters that each query wants, with a score of at least its threshold."""
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", idx.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    read = idx.where(F.col("leaf").isin(np.flatnonzero(wanted.any(axis=0)).tolist())).select("leaf", "terms", "tops", "lengths", "places", "parts", "ids")

    def search(batches):
        found: dict[int, list] = {}
        edge = np.maximum(least, 1)
        for batch in batches:
            for r in range(batch.num_rows):
                leaf, own, tops, lengths = (batch.column(i)[r].as_py() for i in range(4))
                own, lengths = unsqueeze(own, np.uint32), unsqueeze(lengths, np.int32)
                bounds = _bounds(_tops(own, unsqueeze(tops, np.int32), size), queries)
                asked = np.flatnonzero(wanted[:, leaf] & (bounds >= edge))
                if not len(asked):
                    continue
                places, parts = unsqueeze(batch.column(4)[r].as_py(), np.uint32), unsqueeze(batch.column(5)[r].as_py(), np.int32).astype(np.int64)
                ids, ends = batch.column(6)[r].values, np.cumsum(lengths)
                at = np.full(size, -1)
                at[own] = np.arange(len(own))
                for q in asked.tolist():
                    scores = np.zeros(len(ids), np.int64)
                    for i, w in zip(at[queries[q][0]].tolist(), queries[q][1].tolist()):
                        if i >= 0:
                            scores[places[ends[i] - lengths[i] : ends[i]]] += w * parts[ends[i] - lengths[i] : ends[i]]
                    good = best_places(scores, edge[q], k)
                    if len(good):
                        new = [(-s, d is None, d) for s, d in zip(scores[good].tolist(), ids.take(pa.array(good)).to_pylist())]
                        found[q] = sorted([*found.get(q, []), *new], key=lambda x: x if not x[1] else x[:2])[:k]
                        if len(found[q]) == k:
                            edge[q] = max(edge[q], -found[q][-1][0])
        rows = [(q, d, -s) for q, own in found.items() for s, _, d in own]
        cols = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    return read.mapInArrow(tidied(search), schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. Rows meet in two steps: first some of a query's rows, then the best of these."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    some = Window.partitionBy("q", "part").orderBy(*order)
    found = found.withColumn("part", F.pmod(F.xxhash64("id", "score"), F.lit(32)))
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).select("q", "rank", "id", "score")


def _search_block(docs: DataFrame, items: list[tuple], kind: T.DataType, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, rank, id, score) for the items (id of that type, text) of one block."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    named: dict[tuple, int] = {}
    of = []
    for item, text in items:
        held = Counter(terms((text or "").encode()))
        key = tuple(sorted((vocabulary.setdefault(t, len(vocabulary)), c) for t, c in held.items()))
        if key:
            of.append((named.setdefault(key, len(named)), item))
    size = max(1, len(vocabulary))
    vecs = stored(vectors(docs, vocabulary, id_col, text_col), "vectors")
    n_docs, n_terms = vecs.agg(F.count("*"), F.sum("n")).first()
    names = spark.createDataFrame(of, T.StructType([T.StructField("q", T.LongType()), T.StructField("item_id", kind)]))
    found = spark.createDataFrame([], T.StructType([T.StructField("q", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())]))
    if n_docs and named:
        df = holders(vecs, size)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        queries = []
        for key in named:
            t = np.array([x for x, _ in key], np.int64)
            queries.append((t, weight[t] * np.array([c for _, c in key], np.int64)))
        tree = fitted(vecs, n_docs, size)
        idx = index(vecs, tree, n_docs, n_terms)
        bounds = cluster_bounds(idx, queries, size, len(tree) + 1)
        order = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1, kind="stable")
        open_, least, upto = bounds > 0, np.zeros(len(queries), np.int64), FIRST
        while open_.any():
            # Queries whose next clusters are all closed go on to further ones, so every round visits some.
            wanted = open_ & (order < upto)
            upto *= GROWTH
            if not wanted.any():
                continue
            found = found.union(stored(visit(idx, queries, size, wanted, least, k), "found"))
            open_ &= ~wanted
            if open_.any():
                for r in _ranked(found, k).where(F.col("rank") == k).select("q", "score").collect():
                    least[r["q"]] = r["score"]
                open_ &= bounds >= np.maximum(least, 1)[:, None]
    return _ranked(found, k).join(F.broadcast(names), "q").select("item_id", "rank", F.col("id").alias(id_col), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, id, score): the k highest-scoring documents of each item."""
    ship(docs.sparkSession)
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("row"))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    out = None
    for i in range(blocks):
        block = [tuple(r) for r in own.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).select("item_id", "text").collect()]
        found = _search_block(docs, block, own.schema["item_id"].dataType, k, id_col, text_col)
        out = found if out is None else out.union(found)
    return out
