"""Documents that come in pages: chunks of each page, numbered on through a document, and a type of the document on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import text as X
from lodestone.operators import retrieval as R

#: Pages of a document whose chunks are summed up together before the numbering.
BLOCK = 1024


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def first_chunks(counts: DataFrame) -> DataFrame:
    """(doc_id, page, first): how many chunks the pages before have. Sums of blocks of pages come first, so a document of very many pages is no single task's work."""
    counts = counts.withColumn("block", F.floor(F.coalesce("page", F.lit(0)) / BLOCK))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("doc_id", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("doc_id", "block", before(Window.partitionBy("doc_id").orderBy("block")).alias("above"))
    own = before(Window.partitionBy("doc_id", "block").orderBy(F.col("page").asc_nulls_first()))
    return counts.withColumn("own", own).join(blocks, ["doc_id", "block"]).select("doc_id", "page", (F.col("own") + F.col("above")).cast("int").alias("first"))


def page_passages(pages: DataFrame, **how) -> DataFrame:
    """(doc_id, page, chunk_id, text) of (doc_id, page, text): each page is cut by itself, and numbers run on from page to page."""
    cut = R.passages(pages.select(F.struct("doc_id", "page").alias("doc_id"), "text"), **how)
    cut = cut.select("doc_id.doc_id", "doc_id.page", F.col("chunk_id").alias("i"), "text")
    local = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("i")) - 1
    counts = cut.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    first = first_chunks(counts).withColumnsRenamed({"doc_id": "of", "page": "at"})
    joined = cut.withColumn("local", local).join(first, (F.col("doc_id") == F.col("of")) & F.col("page").eqNullSafe(F.col("at")))
    return joined.select("doc_id", "page", (F.col("local") + F.col("first")).alias("chunk_id"), "text")


def document_types(passages: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, doc_type) by name, title and the summaries, else texts, of a document's first eight chunks. ``titles``: (doc_id, stem, title)."""
    some = passages.where("chunk_id < 8").select("doc_id", F.struct("chunk_id", F.coalesce(F.nullif("summary", F.lit("")), "text", F.lit("")).alias("t")).alias("x"))
    some = some.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most eight
    blob = F.concat(F.array(F.lower("stem"), F.lower(F.coalesce("title", F.lit("")))), F.transform(F.coalesce("x", F.array().cast(some.schema["x"].dataType)), lambda x: F.lower(x["t"])))
    text = F.concat(F.get(blob, F.lit(0)), F.array_join(F.transform(F.filter(F.slice(blob, F.lit(2), F.size(blob)), lambda t: t != ""), lambda t: F.concat(F.lit(" \n"), t)), ""))
    return titles.join(some, "doc_id", "left").select("doc_id", C.doc_type(F.col("stem"), text).alias("doc_type"))


def index_pages(pages: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Annotated passages of (doc_id, page, text), with a type of the document on each. ``paths``: (doc_id, source_path); without, a document's id is its name."""
    p = R.annotate(page_passages(pages))
    heads = pages.groupBy("doc_id").agg(F.min_by(F.left("text", F.lit(400)), F.coalesce("page", F.lit(0))).alias("head"))
    named = heads.join(paths, "doc_id", "left") if paths is not None else heads.withColumn("source_path", F.col("doc_id").cast("string"))
    name = F.coalesce(stem(F.col("source_path")) if paths is not None else F.col("source_path"), F.col("doc_id").cast("string"))
    titles = named.select("doc_id", name.alias("stem"), X.title(X.strip(F.coalesce("head", F.lit(""))), name).alias("title"))
    return p.join(document_types(p, titles), "doc_id")
