"""Near duplicates by min-max hashing: banded signatures give candidates, full sets confirm them.

1. Every text's distinct k-word shingles become 64-bit fingerprints. Each of ``PERMUTATIONS`` random affine maps of
   these is a permutation, of which the least and the greatest value are both kept: two sets agree in either with a
   probability of their Jaccard similarity, so one pass of hashing gives two values of a signature, and as a set's
   least and greatest rarely say the same, the share of agreeing values varies less than that of one of them alone.
2. A signature is cut into bands of ``ROWS`` values. Sets that agree in a whole band are candidates. With 40 bands of
   8 a link at the threshold of 0.85 is missed with a probability of (1 - 0.85^8)^40 = 3e-6, one at 0.9 with 1e-10.
   Of a band's sets only links to the smallest are listed; sets joined by such links form a family.
3. Links are confirmed on the full sets within each family, by walks through a prefix tree of all its sets that
   leave out what can't reach the need, so a family's links are exact and no pairs are listed. A family above
   ``most`` shingles is dealt into blocks that all hold its first set; the sets that aren't joined to it within their
   block are then held against the other blocks.

Rows with equal sets are one class before any join. Band keys are counted with map-side sums, and a key that very
many sets hold is joined in several places. Only counts reach the driver; only the names of candidate sets may be
broadcast, below ``MOST_NAMES`` of them, and are otherwise shuffled.

Edge cases: null or empty texts, and texts without a word, have 0 shingles and are a component of their own (their
id; null for a null id), and kept; shorter texts than a shingle are one shingle; equal rows are linked, and rows
that share the smallest id are all kept; a null id is no component's smallest unless all are null; an empty table
gives no row; other columns are ignored, whatever their names. Sets are told apart by 64-bit fingerprints and their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import mix64, partitions, ship, stored, text_slices, tidied, utf8
from lodestone.llm.components import components
from lodestone.llm.jaccard_join import MOST, SALTS, SCAN_BYTES, _across, _grouped, _read_sets, join_family, set_names, shingles

PERMUTATIONS, ROWS = 160, 8
#: Names of candidate sets that are broadcast: 8 bytes each.
MOST_NAMES = 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240613))
_TIMES = _rng.integers(0, 2**63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, size=4096, dtype=np.uint64) * np.uint64(2)


def signatures(keys: np.ndarray, sizes: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(2 x permutations, sets): the least values of each set, then the greatest. No set may be empty."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((2 * permutations, len(sizes)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(permutations):
            values = keys * _TIMES[i] + _PLUS[i]
            np.minimum.reduceat(values, starts, out=out[i])
            np.maximum.reduceat(values, starts, out=out[permutations + i])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The share of agreeing values: an unbiased estimate of the Jaccard similarity."""
    return float((a == b).mean())


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands): a 64-bit key of each band, which no other band's key equals but by chance."""
    at = values.reshape(-1, rows, values.shape[1])
    out = mix64(np.arange(1, len(at) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + at[:, i])
    return out.T.view(np.int64)


def banded(docs: DataFrame, k: int, id_col: str, text_col: str, permutations: int, rows: int) -> DataFrame:
    """(id, set_id, n, bands) of each row; a text without words has no band."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("set_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    wide = 2 * permutations // rows

    def read(batches):
        for batch in batches:
            for a, b, column in text_slices(batch.column(1), SCAN_BYTES):
                keys, sizes = shingles(utf8(column), k)
                names = set_names(keys, sizes)
                own = np.flatnonzero(sizes > 0)
                found = bands(signatures(keys, sizes[own], permutations), rows) if len(own) else np.zeros((0, wide), np.int64)
                ends = np.cumsum(np.where(sizes > 0, wide, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.ascontiguousarray(found).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names), pa.array(sizes), lists], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(tidied(read), schema)


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b): each set with the smallest set of each band that it shares with another."""
    each = sets.select("set_id", F.explode("bands").alias("key"))
    least = each.groupBy("key").agg(F.min("set_id").alias("b"), F.max("set_id").alias("top")).where("b < top").drop("top")
    # A key that very many sets hold meets its least set in SALTS places.
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("set_id", F.lit(5)), F.lit(SALTS)).cast("int"))
    return each.join(least, ["key", "salt"]).select(F.col("set_id").alias("a"), "b").where("a <> b").distinct()


def texts_of(docs: DataFrame, names: DataFrame, k: int, text_col: str) -> DataFrame:
    """(set_id, text): one text of each named set. Texts are read again, and only those of named sets leave their task where the names can be broadcast."""

    def read(batches):
        for batch in batches:
            for a, b, column in text_slices(batch.column(0), SCAN_BYTES):
                found = set_names(*shingles(utf8(column), k))
                _, first = np.unique(found, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[first]), column.take(pa.array(first)).cast(pa.string())], names=["set_id", "text"])

    own = docs.select(text_col).mapInArrow(tidied(read), "set_id long, text string")
    few = names.limit(MOST_NAMES + 1).count() <= MOST_NAMES
    return own.join(F.broadcast(names) if few else names, "set_id").groupBy("set_id").agg(F.first("text").alias("text"))


def confirmed(families: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """(set_id, label): every set but the smallest of its component, and that one, by the links within families (u, v); sizes: (set_id, n)."""
    shards = partitions(families.sparkSession)
    member = families.select(F.col("u").alias("set_id"), F.col("v").alias("family")).union(families.select("v", "v").distinct()).join(sizes, "set_id")
    blocks = member.groupBy("family").agg(F.ceil(F.sum("n") / most).alias("blocks"))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    spread = F.when(F.col("set_id") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    member = member.join(blocks, "family").select("set_id", "family", "blocks", F.explode(spread).alias("block"))

    def within(batches):
        for (family, block, blocks_), held in _grouped(batches, 3):
            names, keys, n, _ = _read_sets(held, k)
            out, _ = join_family(names, keys, n, percent)
            same = lambda x: pa.array(np.full(len(names), x))
            yield pa.RecordBatch.from_arrays([pa.array(names), same(family), same(block), same(blocks_), pa.array(out), same(1)], names=["set_id", "family", "block", "blocks", "label", "copies"])

    laid = member.join(texts, "set_id").select("family", "block", "blocks", "set_id", F.lit(1).alias("copies"), "text")
    laid = laid.repartition(shards, "family", "block").sortWithinPartitions("family", "block")
    label = stored(laid.mapInArrow(tidied(within), "set_id long, family long, block long, blocks long, label long, copies long"), "labels")
    large = label.where("blocks > 1")
    if not large.limit(1).count():  # every family was joined whole
        return label.where("label <> set_id").select("set_id", "label")
    edges = label.select(F.col("set_id").alias("a"), F.col("label").alias("b")).union(_across(large, texts, k, percent, shards, most))
    return components(edges).select(F.col("u").alias("set_id"), F.col("v").alias("label"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", permutations: int = PERMUTATIONS, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """(id, n_shingles, component_id, kept): components of links between rows whose sets of k-word shingles have a Jaccard similarity of at least ``percent``; the row of a component's smallest id is kept."""
    ship(docs.sparkSession)
    each = stored(banded(docs, k, id_col, text_col, permutations, rows), "bands")
    sets = stored(each.where("n > 0").groupBy("set_id").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.first("bands").alias("bands")), "sets")
    families = components(candidates(sets))
    names = families.select(F.col("u").alias("set_id")).union(families.select("v").distinct())
    texts = stored(texts_of(docs, names, k, text_col), "texts")
    roots = stored(confirmed(families, sets.select("set_id", "n"), texts, k, percent, most), "roots")
    classes = sets.select("set_id", "least").join(roots, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    lowest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(lowest, "label").select("set_id", "component_id")
    out = each.select("id", "set_id", "n").join(named, "set_id", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
