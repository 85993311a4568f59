"""Small relational operators around the chain: documents and their files, vectors, snapshots, probes, tables of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import retrieval as R


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


# ---------------------------------------------------------------- words and intents


def alias_tokens(c: Column) -> Column:
    """Distinct alphanumeric words of three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 3))


def alias_fits(alias: Column, query: Column) -> Column:
    """Whether all words of an alias are words of the query."""
    return (F.size(alias_tokens(alias)) > 0) & (F.size(F.array_except(alias_tokens(alias), alias_tokens(query))) == 0)


def context_hash(c: Column) -> Column:
    """Ten hexadecimal digits that name a surrounding, whatever its case and compatibility forms."""
    plain = F.when(c.rlike(r"[^\x00-\x7F]"), X._nfkc(c)).otherwise(c)
    return F.left(F.sha1(F.lower(plain)), F.lit(10))


def asks_for_overview(c: Column) -> Column:
    return X.has_any(F.lower(c), V.OVERVIEW_WORDS)


def asks_for_topic(c: Column) -> Column:
    low = F.lower(F.regexp_replace(c, r"\s+", " "))
    return F.contains(low, F.lit("what are")) & F.contains(low, F.lit("paper"))


def is_paper_primary(modes: Column) -> Column:
    return F.array_contains(modes, "paper")


def short_token_hits(tokens: Column) -> Column:
    """Each short token with its long form, where it has one."""
    return F.transform(F.array_distinct(tokens), lambda t: F.when(X.long_form(t) != "", F.concat(t, F.lit(" ("), X.long_form(t), F.lit(")"))).otherwise(t))


def metric_confidence(figure: Column, runtime: Column) -> Column:
    """How much a record is trusted: found while asking least, in the body of a text most."""
    return F.when(runtime, 0.45).when(figure, 0.6).otherwise(0.7)


def plain_claim(summary: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(summary, F.lit("")), F.left(text, F.lit(280)))


# ---------------------------------------------------------------- documents and files


def scope_aliases(library: DataFrame, manifest: DataFrame) -> DataFrame:
    """The library's documents with the aliases of the manifest's file of the same name."""
    names = manifest.select(basename(F.col("filename")).alias("name"), "scope_aliases").groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("scope_aliases")))).alias("scope_aliases"))
    return library.withColumn("name", basename(F.col("source_path"))).join(names, "name", "left").withColumn("scope_aliases", F.coalesce("scope_aliases", F.array().cast("array<string>"))).drop("name")


def expected_documents(slugs: DataFrame, manifest: DataFrame, library: DataFrame) -> DataFrame:
    """(slug, doc_ids): what the library holds of each asked slug's file; a slug that the manifest lacks is refused."""
    unknown = slugs.join(manifest, "slug", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError("unknown slug: " + ", ".join(r["slug"] for r in unknown))
    held = library.select(basename(F.col("source_path")).alias("name"), "doc_id").groupBy("name").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    own = slugs.select("slug").distinct().join(manifest.select("slug", basename(F.col("filename")).alias("name")), "slug").join(held, "name", "left")
    return own.select("slug", F.coalesce("doc_ids", F.array().cast(held.schema["doc_ids"].dataType)).alias("doc_ids"))


def recent_documents(library: DataFrame, recent: DataFrame) -> DataFrame:
    """(pos, ...) the documents of a list of ids, in its order; ids that the library lacks are left out."""
    return recent.select("pos", "doc_id").join(library, "doc_id")


def missing_documents(passages: DataFrame, library: DataFrame) -> DataFrame:
    """The documents of passages that the library lacks."""
    return passages.select("doc_id").distinct().join(library.select("doc_id"), "doc_id", "left_anti")


def overview(passages: DataFrame, k: int) -> DataFrame:
    """The first passage of the first k documents."""
    first = passages.groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "text"), "chunk_id").alias("p")).orderBy("doc_id").limit(k)
    return first.select("doc_id", "p.chunk_id", "p.text")


def latest(files: DataFrame, stem: str) -> DataFrame:
    """The artefacts whose name begins with a stem, the newest name first."""
    return files.withColumn("name", basename(F.col("path"))).where(F.startswith("name", F.lit(stem))).orderBy(F.col("name").desc())


# ---------------------------------------------------------------- vectors


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors of length one; zero vectors stay, and vectors of several lengths are refused."""
    sizes = vectors.select(F.size(column).alias("n")).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("vectors of several dimensions")
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    length = F.when(norm == 0, 1.0).otherwise(norm)
    return vectors.withColumn(column, F.transform(F.arrays_zip(F.col(column).alias("x"), F.array_repeat(length, F.size(column)).alias("n")), lambda z: z["x"] / z["n"]))


def positive_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best k (one at least) inner products above 0."""
    return R.dense_top(queries, vectors, max(k, 1)).where("score > 0")


# ---------------------------------------------------------------- snapshots


def snapshots(sessions: DataFrame) -> DataFrame:
    """Stored sessions, the latest first."""
    return sessions.orderBy(F.col("updated").desc(), F.col("created").desc(), F.col("name").desc())


def without(sessions: DataFrame, names: DataFrame) -> DataFrame:
    return sessions.join(names.select("name").distinct(), "name", "left_anti")


def payload(row: Column) -> Column:
    """A snapshot's state as text; ``restored`` reads it and leaves out fields it doesn't know."""
    return F.to_json(row)


def restored(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def checklist_done(flags: Column) -> Column:
    return F.forall(F.map_values(flags), lambda x: x)


# ---------------------------------------------------------------- reports


def evidence_set(passages: DataFrame, mode: str) -> DataFrame:
    """(query_id, label, confidence, evidence): a query's passage texts, in their order, as one text; blank ones are left out."""
    own = passages.where(X.strip(F.col("text")) != "")
    texts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    rows = own.groupBy("query_id").agg(F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("evidence"), F.count("*").alias("n"))
    asked = passages.select("query_id").distinct().join(rows, "query_id", "left")
    return asked.select("query_id", F.lit(mode).alias("label"), F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("confidence"), F.coalesce("evidence", F.lit("")).alias("evidence"))


def row_flags(rows: DataFrame) -> DataFrame:
    """Target and overlap flags of report rows: their own, else what the ids say; and whether the row failed."""
    meets = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    out = rows.withColumn("target_ok", F.coalesce("inferred", meets("expected", "targets"))).withColumn("overlap_ok", F.coalesce("overlapping", meets("expected", "final")))
    return out.withColumn("failed", ~(F.col("target_ok") & F.col("overlap_ok") & F.coalesce("passed", F.lit(True))))


def probe_summary(rows: DataFrame) -> DataFrame:
    """(scope_source, n, inferred_rate, overlap_rate) with a line ``all``; rates of no rows are 0."""
    out = rows.rollup("scope_source").agg(F.count("*").alias("n"), F.count_if("target_ok").alias("i"), F.count_if("overlap_ok").alias("o"))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0)), 6)
    return out.select(F.coalesce("scope_source", F.lit("all")).alias("scope_source"), "n", rate("i").alias("inferred_rate"), rate("o").alias("overlap_rate"))


def structured_counts(s: DataFrame) -> DataFrame:
    """How many entries each list of a synthesis has."""
    return s.select("query_id", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("claims", "metrics", "unsupported", "limitations", "conflicts")))


def latency_totals(timings: DataFrame) -> DataFrame:
    """(run, cold, warm): the sum of a run's stage times by the state of the cache."""
    return timings.groupBy("run").agg(*(F.round(F.sum(F.when(F.col("cache_state") == s, F.col("ms"))), 6).alias(s) for s in ("cold", "warm")))


def monitoring(runs: DataFrame) -> DataFrame:
    """(slug, trigger): documents with three runs in a row without metrics, or two off target; the reasons to look again."""
    order = Window.partitionBy("slug").orderBy("run")
    out = []
    for name, bad, least in (("no metrics", F.col("metric_count") == 0, 3), ("off target", F.col("status") == "off_target_evidence", 2)):
        marked = runs.withColumn("bad", bad).withColumn("group", F.sum(F.when(~bad, 1).otherwise(0)).over(order))
        streak = marked.where("bad").groupBy("slug", "group").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        out.append(streak.select("slug", F.lit(name).alias("trigger")).distinct())
    return out[0].union(out[1])


def comparison(queries: DataFrame, lib: R.Library, dense: DataFrame, k: int) -> DataFrame:
    """(query_id, method, doc_id, chunk_id, rank) of several retrievers side by side."""
    ways = {m: R.search(queries, lib, m, k) for m in R.BACKENDS} | {"dense": dense.where(F.col("rank") <= k)}
    out = None
    for name, df in ways.items():
        rows = df.select("query_id", F.lit(name).alias("method"), "doc_id", "chunk_id", F.col("rank").cast("long").alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return out
