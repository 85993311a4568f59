"""Vectors that are reached by row numbers, questions that are encoded once, and a dense run that may be missing."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import retrieval as R

#: Keys of one stretch that are numbered together.
STRETCH = 65_536


def hashed(text: Column, size: int = 64) -> Column:
    """A unit vector of the counts of hashed words, ``size`` places; null for a text without words. Made in Arrow batches."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        place: dict[bytes, int] = {}
        out = []
        for text in texts:
            v = np.zeros(size)
            for word, n in Counter((text or "").lower().encode().translate(R._OTHERS).split()).items():
                if len(word) >= 2:
                    if word not in place:
                        place[word] = int(hashlib.md5(word).hexdigest()[:4], 16) % size
                    v[place[word]] += n
            out.append(v / np.sqrt(np.dot(v, v)) if v.any() else None)
        return pd.Series(out, dtype=object)

    return vectors(text)


def numbered(rows: DataFrame, order: list[str], stretch: Column) -> DataFrame:
    """The rows with a ``row_id`` from 0 without gaps, in the order given; ``stretch`` rises with that order and cuts it into parts.

    Parts are counted, counts are summed up, and each part is numbered by itself: no task sees more rows than a part has,
    and the sum goes over one row a part. Rows whose key is null have no number and are left out.
    """
    own = rows.where(F.col(order[0]).isNotNull()).withColumn("stretch", stretch)
    counts = own.groupBy("stretch").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("stretch", above.alias("above"))
    local = F.row_number().over(Window.partitionBy("stretch").orderBy(*order)) - 1
    return own.withColumn("local", local).join(counts, "stretch").select(*rows.columns, (F.col("local") + F.col("above")).alias("row_id"))


def by_stretch(key: str, size: int = STRETCH) -> Column:
    return F.floor(F.col(key) / size)


def looked_up(hits: DataFrame, index: DataFrame, passages: DataFrame) -> DataFrame:
    """Hits (with ``row_id``) with key and passage: number to key, key to passage; what has neither is dropped."""
    return hits.join(index.select("row_id", "doc_id", "chunk_id"), "row_id").join(passages, ["doc_id", "chunk_id"])


def access(hits: DataFrame, index: DataFrame, passages: DataFrame) -> DataFrame:
    """All hits with ``state``: found, out of range (no row has the number) or no passage (its key has none)."""
    keyed = hits.join(index.select("row_id", "doc_id", "chunk_id"), "row_id", "left")
    there = keyed.join(passages.withColumn("there", F.lit(True)), ["doc_id", "chunk_id"], "left")
    state = F.when(F.col("there"), "found").when(F.col("chunk_id").isNull(), "out of range").otherwise("no passage")
    return there.withColumn("state", state).drop("there")


def question_key(query: Column) -> Column:
    """Lower case, trimmed: questions of one key share a vector."""
    return F.lower(X.strip(query))


def encode_once(queries: DataFrame, known: DataFrame, encode: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((query_id, embedding), new rows of the known table, one row of counts) for (query_id, query) and known (key, embedding).

    A key that is not known is encoded once, however many questions have it: the first of them is a miss, the others
    are hits. Blank questions, and those that can't be encoded, have no vector.
    """
    own = queries.withColumn("key", question_key(F.col("query")))
    asked = own.where("key <> ''").groupBy("key").agg(F.count("*").alias("n"))
    new = asked.join(known.select("key"), "key", "left_anti").select("key", encode(F.col("key")).alias("embedding"))
    whole = known.select("key", "embedding").unionByName(new)
    vectors = own.join(whole, "key").where("embedding is not null").select("query_id", "embedding")
    marked = asked.join(known.select("key", F.lit(True).alias("known")), "key", "left")
    misses = F.count_if(F.col("known").isNull())
    counts = marked.agg((F.coalesce(F.sum("n"), F.lit(0)) - misses).alias("hits"), misses.alias("misses"), F.coalesce(F.sum("n"), F.lit(0)).alias("asked"))
    return vectors, new, counts


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of the right length without nulls and non-finite components."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size("embedding") == size) & F.coalesce(sound, F.lit(False)))


def attempted(make: Callable[[], DataFrame], stored: Callable[[DataFrame, str], DataFrame], name: str = "dense") -> tuple[DataFrame | None, str | None]:
    """(the stored table, null) or (none, a warning): a dense run that fails leaves the sparse ones alone."""
    try:
        return stored(make(), name), None
    except PySparkException as e:
        return None, f"{name} unavailable, sparse only: {e.getCondition() or type(e).__name__}"


def warnings(queries: DataFrame, run: DataFrame | None, warning: str | None) -> DataFrame:
    """(query_id, warning) of the questions that have sparse results only."""
    if run is None:
        return queries.select("query_id", F.lit(warning).alias("warning"))
    return queries.join(run.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("no vector, sparse only").alias("warning"))
