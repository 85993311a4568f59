"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Every stage keeps rows apart by a key of their own, so rows that share an id, or have none, are judged one by one. Null
and empty texts: not toxic (unless the intercept says so), of no language (they go in the second stage), without words
in the third and fourth. Empty tables give empty tables, and other columns are carried along; the keys take names that
the documents don't have.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, fst_tokens, jaccard_join, langid, packing, toxicity
from lodestone.llm.common import scratch, shared_dir, stored

TOKENIZER = "byte_bpe_50k.json"
SHINGLE, SIMILAR = 5, 80
#: Languages that are kept: None for all that the network learnt. Least share of a text that it takes for language of
#: any kind, and bytes below which a text says too little to go by that share.
LANGUAGES: tuple[str, ...] | None = None
LEAST_LANGUAGE, SHORT = 0.05, 128


def _free(docs: DataFrame, name: str) -> str:
    """The name, longer by underscores until no column begins with it."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once, with a key of each (none, id, row) that sorts by id, null ids last; and its name."""
    name = _free(docs, "_key")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"))
    return stored(docs.withColumn(name, key), "rows"), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier, learnt from the labelled ones, doesn't predict to be toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    new = _free(docs, "_tox_")
    scored = toxicity.score(docs, model, keep=docs.columns, prefix=new)
    return scored.where(F.col(f"{new}predicted") == 0).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES) -> DataFrame:
    """Rows that the network gives a wanted language: not ``und``, and not taken for bytes in no order."""
    new = _free(docs, "_id_")
    known = langid.predict(docs, langid.train(docs), keep=docs.columns, prefix=new)
    said = F.col(f"{new}lang_pred") != langid.UNKNOWN if languages is None else F.col(f"{new}lang_pred").isin(*languages)
    sure = (F.col(f"{new}language_share") >= LEAST_LANGUAGE) | (F.octet_length("text") < SHORT)
    return known.where(said & sure).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each component of near copies; rows without a word stay."""
    rows, key = _keyed(docs)
    found = jaccard_join.join(rows, k=SHINGLE, percent=SIMILAR, id_col=key)
    gone = found.where((F.col("n_shingles") > 0) & (F.col("component_id") != F.col(key))).select(key)
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    rows, key = _keyed(docs)
    found = decontam.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return rows.join(found.where("contaminated").select(key), key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 1024 tokens."""
    pieces = packing.pack(docs, fst_tokens.resolve(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learnt models decide in the first two stages: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again, what it needed besides goes."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
