"""Sources and sinks: text files, manifests, matrices, reports, tables of passages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X

SUFFIXES = ["pdf", "txt", "md"]
MANIFEST = "version string, documents array<struct<slug:string,title:string,filename:string,buckets:array<string>,modes:array<string>,scope_aliases:array<string>,source_url:string,notes:string,expected_doc_type:string>>"
MATRIX = "version string, mode string, min_papers int, papers array<struct<slug:string,expected_bucket:string,notes:string,tasks:array<struct<task_type:string,query:string,expected_auto:map<string,string>>>>>"
PROBES = "documents array<struct<slug:string,queries:array<struct<id:string,task_type:string,query:string>>>>"
# Buckets, modes and task types that a manifest or matrix may name.
BUCKETS = ["core", "generalization", "stress", "mode-specific", "anti-overfitting"]
MODES = ["paper", "assembly", "variant"]
TASKS = ["scoped_document_query", "metric_extraction_query", "supported_claim_query", "unsupported_topic_query", "limitation_conflict_query"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, text) of text and markdown files below a folder, cleaned; bytes that aren't UTF-8 are dropped by the reader."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("source_path"), X.clean_text(F.col("value")).alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, bytes, sha256) of supported files, newest first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = found.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES))
    return own.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy(F.col("modified").desc(), "path")


def _refuse(bad: DataFrame, what: str) -> None:
    if rows := bad.limit(5).collect():
        raise ValueError(f"{what}: " + ", ".join(str(r[0]) for r in rows))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, checked: required fields, known buckets and modes, unique slugs, aliases of one slug only."""
    docs = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.*")
    tags = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    docs = docs.withColumn("buckets", tags("buckets")).withColumn("modes", tags("modes")).withColumn("scope_aliases", tags("scope_aliases"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    _refuse(docs.where(blank("slug") | blank("title") | blank("filename")).select(F.coalesce("slug", F.lit("?"))), "slug, title and filename are required")
    _refuse(docs.groupBy("slug").count().where("count > 1").select("slug"), "duplicate slug")
    for c, known in (("buckets", BUCKETS), ("modes", MODES)):
        _refuse(docs.select(F.explode(c).alias("t")).where(~X.tag(F.col("t")).isin(*[k.replace("-", "_") for k in known])), f"unknown {c}")
    names = docs.select("slug", F.explode("scope_aliases").alias("a")).select(X.tag(F.col("a")).alias("a"), "slug")
    _refuse(names.groupBy("a").agg(F.count_distinct("slug").alias("n")).where("n > 1").select("a"), "alias of several slugs")
    return docs


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """One row a task of the validation matrix; unknown task types are refused."""
    tasks = spark.read.schema(MATRIX).option("multiLine", "true").json(path).select(F.explode("papers").alias("p")).select("p.slug", "p.expected_bucket", F.explode("p.tasks").alias("t")).select("slug", "expected_bucket", "t.*")
    _refuse(tasks.where(~F.col("task_type").isin(*TASKS)).select("task_type"), "unknown task type")
    return tasks


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBES).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.slug", F.explode("d.queries").alias("q")).select("slug", "q.*")


def report_kind(spark: SparkSession, path: str) -> str:
    """probe or validation, by the list that a report holds."""
    names = spark.read.option("multiLine", "true").json(path).columns
    if "rows" in names:
        return "probe"
    if "results" in names:
        return "validation"
    raise ValueError(f"{path}: neither rows nor results")


def write_passages(p: DataFrame, path: str) -> None:
    """One folder a document; documents written again replace their own folder only."""
    p.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """As JSON and, with lists joined by ``;``, as CSV."""
    rows.write.mode("overwrite").json(f"{path}/json")
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def append_vectors(v: DataFrame, path: str) -> None:
    v.write.mode("append").parquet(path)


def same_manifest(spark: SparkSession, path: str, expected: dict[str, str]) -> bool:
    """Whether the sidecar of a stored index says what is expected of model, dimension and chunker."""
    try:
        have = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/_manifest").collect()}
    except Exception:  # no sidecar: not the same
        return False
    return have == expected


def write_manifest(spark: SparkSession, path: str, manifest: dict[str, str]) -> None:
    spark.createDataFrame(list(manifest.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
