"""Queries of the whole service: vectors by row number, questions encoded once, reviews in three modes, probes and validation.

The library is made of all documents: each has a heading, a line of findings that its language stands for (metrics,
variants, measures of an assembly or none), and its own text. Each benchmark item asks of one of them in one of five ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import metrics
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import catalog as K
from lodestone.operators import evaluation as E
from lodestone.operators import hybrid, modes, quality, synthesis
from lodestone.operators import pages as G
from lodestone.operators import reports as P
from lodestone.operators import retrieval as R
from lodestone.operators import service as Z
from lodestone.operators import vectors as D
from lodestone.plans.queries import _PASSAGES, _TOKENS, _library, asked, query, read
from lodestone.sources import tables as S

# ---------------------------------------------------------------- vectors

_PLACE = "CAST((instr('0123456789abcdef', h[1]) - 1) * 4096 + (instr('0123456789abcdef', h[2]) - 1) * 256 + (instr('0123456789abcdef', h[3]) - 1) * 16 + instr('0123456789abcdef', h[4]) - 1 AS BIGINT) % 64"
_HASHED = lambda source, keys: rf"""SELECT {keys}, list_transform(list_zip(v, list_resize([sqrt(list_sum(list_transform(v, lambda x: x * x)))], 64, sqrt(list_sum(list_transform(v, lambda x: x * x))))), lambda z: z[1] / z[2]) AS e
  FROM (SELECT {keys}, list_transform(range(0, 64), lambda i: CAST(len(list_filter(s, lambda x: x = i)) AS DOUBLE)) AS v FROM (SELECT {keys}, list_transform({_TOKENS("text")}, lambda w: {_PLACE.replace("h[", "md5(w)[")}) AS s FROM {source}) WHERE len(s) > 0)"""  # noqa: E731
_ROWS = f"{_PASSAGES}, ids AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS row_id FROM p)"


@query(f"""WITH {_ROWS}, v AS ({_HASHED("ids", "doc_id, chunk_id, row_id")}), q AS ({_HASHED("(SELECT item_id AS query_id, text FROM benchmark)", "query_id")}),
s AS (SELECT query_id, doc_id, chunk_id, row_id, round(list_sum(list_transform(range(1, 65), lambda i: q.e[i] * v.e[i])), 6) AS score FROM q, v)
SELECT query_id, doc_id, chunk_id, row_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s) WHERE rank <= 6""")
def dense_rows(spark, sf_dir):
    """The nearest passages of each benchmark text by vectors of hashed words: numbers first, then keys and passages."""
    p = _library(spark, sf_dir).passages.select("doc_id", "chunk_id", D.hashed(F.col("text")).alias("embedding"))  # encoded before numbering moves the rows
    v = S.written(D.numbered(p, ["doc_id", "chunk_id"], D.by_stretch("doc_id", 500)).where("embedding is not null").select("row_id", "doc_id", "chunk_id", "embedding"), "row-vectors")
    q = asked(spark, sf_dir).select("query_id", D.hashed(F.col("query")).alias("embedding")).where("embedding is not null")
    near = R.dense_top(q, v.select(F.col("row_id").alias("vec_id"), "embedding"), 6).withColumnRenamed("vec_id", "row_id")
    return D.looked_up(near, v, _library(spark, sf_dir).passages.select("doc_id", "chunk_id")).select("query_id", "doc_id", "chunk_id", "row_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_ROWS}, h AS (SELECT doc_id * 3 - 50 AS row_id, doc_id AS hit FROM labels), g AS (SELECT * FROM p WHERE length(text) % 7 > 0)
SELECT hit, h.row_id, coalesce(ids.doc_id, -1) AS doc_id, coalesce(ids.chunk_id, -1) AS chunk_id, CASE WHEN ids.row_id IS NULL THEN 'out of range' WHEN g.doc_id IS NULL THEN 'no passage' ELSE 'found' END AS state, md5(g.text) AS digest FROM h LEFT JOIN ids USING (row_id) LEFT JOIN g ON g.doc_id = ids.doc_id AND g.chunk_id = ids.chunk_id""")
def row_access(spark, sf_dir):
    """Numbers made of the ids of labels, some out of range, among passages of which some were withdrawn."""
    p = _library(spark, sf_dir).passages
    rows = D.numbered(p.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], D.by_stretch("doc_id", 500))
    hits = read(spark, sf_dir, "labels").select((F.col("doc_id") * 3 - 50).alias("row_id"), F.col("doc_id").alias("hit"))
    left = p.where(F.length("text") % 7 > 0)
    return D.access(hits, rows, left).select("hit", "row_id", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), "state", F.md5("text").alias("digest"))


@query("""WITH k AS (SELECT role, lower(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS key FROM conversations), known AS (SELECT DISTINCT key FROM k WHERE role = 'assistant' AND key <> ''),
a AS (SELECT key, count(*) AS n FROM k WHERE role IS DISTINCT FROM 'assistant' AND key <> '' GROUP BY key)
SELECT CAST(coalesce(sum(n), 0) - count(*) FILTER (WHERE key NOT IN (SELECT key FROM known)) AS BIGINT) AS hits, count(*) FILTER (WHERE key NOT IN (SELECT key FROM known)) AS misses, CAST(coalesce(sum(n), 0) AS BIGINT) AS asked FROM a""")
def encoded_questions(spark, sf_dir):
    """How many turns of users find the vector of an equal text that was encoded before, by an assistant's turn or one of their own."""
    c = read(spark, sf_dir, "conversations")
    known = c.where("role = 'assistant'").select(D.question_key(F.col("text")).alias("key")).where("key <> ''").distinct().withColumn("embedding", D.hashed(F.col("key")))
    own = c.where(~F.col("role").eqNullSafe("assistant")).select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    return D.encode_once(own, known, D.hashed)[2]


# ---------------------------------------------------------------- the library and its questions

_LANG = "coalesce(lang, 'none')"
_REPORTS = f"reports AS (SELECT doc_id, {_LANG} AS lang, 'Report x' || doc_id || ' of the ' || {_LANG} || ' series' AS title, '10.5000/x' || doc_id AS doi FROM documents)"
_QUESTIONS = """questions AS (SELECT 'r' || item_id AS query_id, item_id * 5 + 1 AS d, item_id % 5 AS way, CASE item_id % 5 WHEN 0 THEN b.text WHEN 1 THEN b.text || ' Which accuracy is given? See 10.5000/X' || (item_id * 5 + 1) || '.'
  WHEN 2 THEN coalesce(r.title, 'No report') || ': ' || b.text WHEN 3 THEN b.text || ' See 10.5000/X' || (item_id * 5 + 1) || '.' ELSE 'Which accuracy does this report give? ' || b.text END AS query FROM benchmark b LEFT JOIN reports r ON r.doc_id = item_id * 5 + 1)"""


def _reports(spark, sf_dir) -> DataFrame:
    """(doc_id, lang, title, text, aliases)."""
    d = read(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("none"))).withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    number = F.col("doc_id").cast("string")
    title = F.concat(F.lit("Report x"), number, F.lit(" of the "), "lang", F.lit(" series"))
    share = F.format_string("0.%02d", F.col("n") % 100)
    finding = (
        F.when(F.col("lang") == "en", F.concat(F.lit("The model DYNA was better, with Accuracy: "), share, F.lit(" and AUC: "), F.format_string("0.%02d", F.col("n") % 97), F.lit(" on ClinVar.")))
        .when(F.col("lang") == "de", F.concat(F.format_string("The missense variant MYH7 c.%dA>G", F.col("n") % 50), F.when(F.col("n") % 2 == 0, " is pathogenic").otherwise(" is benign"), F.format_string(" by ClinVar classification in %d cases and %d controls of European ancestry, gnomAD ", F.col("n") % 31, F.col("n") % 37), share, F.lit(".")))
        .when(F.col("lang") == "fr", F.concat(F.format_string("Assembly contig N50: %d\nBUSCO completeness: ", F.col("n")), share, F.lit("\nscaffold count: 7")))
        .otherwise("No finding is given here, and nothing else is said.")
    )
    text = F.concat(title, F.lit("\n"), finding, F.lit("\ndoi 10.5000/x"), number, F.lit(" of it\n"), F.coalesce("text", F.lit("")))
    return d.select("doc_id", "lang", title.alias("title"), text.alias("text"), F.array().cast("array<string>").alias("aliases"))


def _questions(spark, sf_dir) -> DataFrame:
    """query_id, item_id, doc_id, query, mode, override, variant_id, phenotype, sample_id."""
    b = read(spark, sf_dir, "benchmark").withColumn("doc_id", F.col("item_id") * 5 + 1)
    b = b.join(_reports(spark, sf_dir).select("doc_id", "title"), "doc_id", "left")
    way, number = F.col("item_id") % 5, F.col("doc_id").cast("string")
    doi = F.concat(F.lit("See 10.5000/X"), number, F.lit("."))
    said = (
        F.when(way == 0, F.col("text")).when(way == 1, F.concat("text", F.lit(" Which accuracy is given? "), doi)).when(way == 2, F.concat(F.coalesce("title", F.lit("No report")), F.lit(": "), "text"))
        .when(way == 3, F.concat("text", F.lit(" "), doi)).otherwise(F.concat(F.lit("Which accuracy does this report give? "), "text"))
    )
    mode = F.when(F.col("item_id") % 4 == 2, "variant").when(F.col("item_id") % 4 == 3, "assembly").otherwise("paper")
    return b.select(
        F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("query_id"), "item_id", "doc_id", said.alias("query"), mode.alias("mode"), F.when(way == 4, F.array("doc_id")).alias("override"),
        F.when(F.col("item_id") % 8 == 2, F.lit("c.7A>G")).alias("variant_id"), F.lit(None).cast("string").alias("phenotype"), F.concat(F.lit("x"), number).alias("sample_id"),
    )


def _manifest(spark, sf_dir) -> DataFrame:
    """What is expected of each document: its type by its language, French ones wrongly as papers only."""
    lang = F.col("lang")
    return _reports(spark, sf_dir).select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("slug"), F.when(lang == "de", F.array(F.lit("paper"), F.lit("variant"))).otherwise(F.array(F.lit("paper"))).alias("modes"), F.when(lang == "de", "variant").when(lang == "en", "paper").when(lang == "es", "assembly").alias("expected_doc_type"), F.array("doc_id").alias("expected"))


_TASKS = ["scoped_document_query", "metric_extraction_query", "supported_claim_query", "unsupported_topic_query", "limitation_or_conflict_query"]


def _probes(spark, sf_dir) -> DataFrame:
    """slug, query_id, task_type, query, least_metrics: the same questions as probes; documents that aren't there are faults."""
    q = _questions(spark, sf_dir)
    task = F.get(F.array(*map(F.lit, _TASKS)), (F.col("item_id") % 5).cast("int"))
    return q.select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("slug"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("query_id"), task.alias("task_type"), "query", F.lit(1).alias("least_metrics"))


_TABLES = ("questions", "targets", "types", "stages", "decisions", "final", "synthesis", "pages", "warnings")


def _reviewed(spark, sf_dir) -> dict[str, DataFrame]:
    """The stored run of all questions and probes, made once; made anew when the files or the code change."""
    docs = read(spark, sf_dir, "documents")
    files = {"files": S.state_of(docs), "asked": S.state_of(read(spark, sf_dir, "benchmark")), "code": S.code_of(X, C, V, R, D, Z, modes, hybrid, quality, synthesis, metrics, G)}
    whole = _reports(spark, sf_dir)
    vectors = lambda t: D.numbered(t["passages"].select("doc_id", "chunk_id", D.hashed(F.col("text")).alias("embedding")), ["doc_id", "chunk_id"], D.by_stretch("doc_id", 500)).where("embedding is not null").select("row_id", "doc_id", "chunk_id", "embedding")
    index = S.kept(spark, "review-library", files, R.Library.of_documents(whole) | {"vectors": vectors})
    made: dict[str, DataFrame] = {}

    def part(name: str) -> DataFrame:
        if not made:
            q = _questions(spark, sf_dir).drop("item_id", "doc_id").unionByName(Z.probe_questions(_probes(spark, sf_dir), _manifest(spark, sf_dir)))
            made.update(Z.review(q, R.Library(None, index), whole, index["vectors"], D.hashed, lambda df, n: S.written(df, f"review-{n}")))
        return made[name]

    return S.kept(spark, "review", files, {n: lambda t, n=n: part(n) for n in _TABLES})


@query(rf"""WITH {_REPORTS}, {_QUESTIONS}, k AS (SELECT query_id, d, way, regexp_replace(lower(query), '[^a-z0-9]+', '', 'g') AS t FROM questions),
n AS (SELECT doc_id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS title, regexp_replace(lower(doi), '[^a-z0-9]+', '', 'g') AS doi FROM reports)
SELECT query_id, doc_id, 'inferred' AS scope_source FROM k, n WHERE way <> 4 AND (contains(t, title) OR contains(t, doi)) UNION ALL SELECT query_id, d, 'context_override' FROM k WHERE way = 4""")
def review_targets(spark, sf_dir):
    """The documents that each question names by title or DOI, or is given."""
    q = _questions(spark, sf_dir)
    return Z.scopes(q, _reports(spark, sf_dir)).select("query_id", "doc_id", "scope_source")


@query()
def review_stages(spark, sf_dir):
    """Every stage of every question in its mode, seeds included."""
    return _reviewed(spark, sf_dir)["stages"]


@query()
def review_decisions(spark, sf_dir):
    """What becomes of each candidate of a question, and why."""
    return _reviewed(spark, sf_dir)["decisions"].select("query_id", "doc_id", "chunk_id", "final_rank", "reason")


@query()
def review_pages(spark, sf_dir):
    """The page of each question in its mode."""
    return _reviewed(spark, sf_dir)["pages"]


@query()
def review_probes(spark, sf_dir):
    """A row a probe, as the probe runner reports it."""
    rows = Z.probe_rows(_probes(spark, sf_dir), _manifest(spark, sf_dir), (run := _reviewed(spark, sf_dir)), run["types"])
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("slug", "query_id", "task_type", "scope_source", "inferred", "overlapping", "status", "claims", "unsupported", "limitations", "conflicts", "metric_count", "blocked", F.array_join("reasons", ";").alias("reasons"), ids("targets"), ids("final_ids"))


@query()
def review_probe_report(spark, sf_dir):
    """Failures of the probes by class, integrity by reason, and rates by the source of the scope."""
    rows = Z.probe_rows(_probes(spark, sf_dir), _manifest(spark, sf_dir), (run := _reviewed(spark, sf_dir)), run["types"])
    line = lambda df, part, name, n: df.select(F.lit(part).alias("part"), F.col(name).alias("name"), F.col(n).cast("double").alias("value"))
    failures = line(P.probe_failures(rows), "failure", "failure", "n")
    reasons = line(rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")), "integrity", "reason", "n")
    scope = K.probe_summary(rows.withColumn("target_ok", F.col("inferred")).withColumn("overlap_ok", F.col("overlapping")))
    return failures.unionByName(reasons).unionByName(line(scope, "inferred rate", "scope_source", "inferred_rate")).unionByName(line(scope, "overlap rate", "scope_source", "overlap_rate"))


@query()
def review_validation(spark, sf_dir):
    """A row a task with its automatic checks."""
    rows = Z.validation_rows(_probes(spark, sf_dir), _manifest(spark, sf_dir), _reviewed(spark, sf_dir))
    said = F.array_join(F.array_sort(F.transform(F.map_entries("checks"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";")
    return rows.select("slug", "query_id", "task_type", "status", said.alias("checks"), "passed")


@query()
def review_validation_report(spark, sf_dir):
    """Rates by task type, and what failed."""
    rows = Z.validation_rows(_probes(spark, sf_dir), _manifest(spark, sf_dir), _reviewed(spark, sf_dir))
    failed = rows.withColumn("check", F.explode(F.map_keys(F.map_filter("checks", lambda k, v: ~v))))
    rates = E.validation_summary(rows).select(F.lit("task type").alias("dimension"), F.col("task_type").alias("value"), (F.col("total") - F.col("passed")).alias("failures"), "rate")
    broken = E.failure_breakdown(failed).where("dimension = 'check'")
    return rates.unionByName(broken.select("dimension", "value", "failures", F.lit(None).cast("double").alias("rate")))


@query(f"""WITH {_REPORTS}, q AS (SELECT item_id, item_id * 5 + 1 AS d, text FROM benchmark)
SELECT 'x' || d AS slug, 'p' || item_id AS query_id, 'not in the manifest' AS fault FROM q WHERE d NOT IN (SELECT doc_id FROM reports)""")
def probe_faults(spark, sf_dir):
    """Probes that can't be run."""
    return Z.probe_faults(_probes(spark, sf_dir), _manifest(spark, sf_dir))
