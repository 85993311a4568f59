"""Queries over the tables of a folder, and SQL that gives the same rows.

Some borrow a table for an operator: labels stand in for validation rows, events for timings and cache
accesses, conversations for answers and sessions, parts for metric records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import dialogue as D
from lodestone.functions import metrics as M
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import catalog as K
from lodestone.operators import evaluation as E
from lodestone.operators import evidence as S
from lodestone.operators import hybrid as H
from lodestone.operators import quality as Q
from lodestone.operators import reports as P
from lodestone.operators import retrieval as R
from lodestone.operators import synthesis as Y
from lodestone.sources import library as L
from lodestone.sources import tables as S_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# ---------------------------------------------------------------- pieces of SQL

_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_TOKENS = lambda x: rf"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9_+\-./ ]+', ' ', 'g'), ' +'), lambda z: length(z) >= 2)"
_DIGITS = lambda x: rf"length(regexp_replace({x}, '[^\p{{Nd}}]', '', 'g'))"
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_COUNT = lambda x, ws: "(" + " + ".join(f"contains({x}, '{w}')::INT" for w in ws) + ")"
_TABLE = r"""(regexp_matches(left(t, 200), '(?i)(table|figure|fig\.?)\s+\d+')
  OR (len(string_split(t, chr(10))) > 2 AND len(list_filter(string_split(t, chr(10)), lambda z: contains(z, '|') OR contains(z, chr(9)))) > 0.5 * len(string_split(t, chr(10))))
  OR (len(regexp_extract_all(t, '\d+\.?\d*')) > 20 AND length(t) < 500))"""
#: Passages of one-paragraph documents.
_PASSAGES = rf"""
raw AS (SELECT doc_id, {_STRIP("text")} AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 1700.0) AS BIGINT))) AS i FROM raw WHERE length(t) > 1700),
sliced AS (SELECT doc_id, i, {_STRIP("substring(t, i * 1700 + 1, 1700)")} AS cur, {_STRIP("substring(t, greatest(i - 1, 0) * 1700 + 1, 1700)")} AS prev FROM cut),
p AS (SELECT doc_id, 0 AS chunk_id, CASE WHEN {_TABLE} THEN '[TABLE/FIGURE]' || chr(10) || t ELSE t END AS text FROM raw WHERE length(t) BETWEEN 1 AND 1700
  UNION ALL SELECT doc_id, CAST(i AS INT), CASE WHEN i > 0 AND prev <> '' THEN {_STRIP("prev || chr(10) || chr(10) || cur")} ELSE cur END FROM sliced)"""
_POSTINGS = f"""{_PASSAGES},
toks AS (SELECT doc_id, chunk_id, {_TOKENS("text")} AS w FROM p),
post AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, unnest(w) AS term FROM toks) GROUP BY ALL),
lens AS (SELECT doc_id, chunk_id, len(w) AS length FROM toks),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term),
idf AS (SELECT term, ln(((SELECT count(DISTINCT doc_id) FROM post) + 1) / (df + 1.0)) AS idf FROM df)"""
_ASKED = f"""q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS("text")}) AS term FROM benchmark) GROUP BY ALL)"""
_BM25 = f"""{_POSTINGS}, {_ASKED},
bm AS (SELECT query_id, doc_id, chunk_id, round(sum(times * coalesce(idf, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT avg(length) FROM lens)))), 6) AS score
  FROM post JOIN lens USING (doc_id, chunk_id) JOIN q USING (term) LEFT JOIN idf USING (term) GROUP BY ALL HAVING score > 0),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM bm)"""
_TFIDF = """,
m AS (SELECT doc_id, chunk_id, max(tf) AS m, sqrt(sum((tf * idf) ** 2)) / max(tf) AS norm FROM post JOIN idf USING (term) GROUP BY ALL),
qq AS (SELECT query_id, term, times, coalesce(idf, 0) AS idf FROM q LEFT JOIN idf USING (term)),
qm AS (SELECT query_id, max(times) AS qm, sqrt(sum((times * idf) ** 2)) / max(times) AS qnorm FROM qq GROUP BY ALL),
tf AS (SELECT query_id, doc_id, chunk_id, round(sum(post.tf * idf.idf * times / qm * qq.idf) / any_value(m.m) / any_value(norm) / any_value(qnorm), 6) AS score
  FROM post JOIN idf USING (term) JOIN qq USING (term) JOIN qm USING (query_id) JOIN m USING (doc_id, chunk_id) WHERE norm > 0 AND qnorm > 0 GROUP BY ALL HAVING score > 0),
tfr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM tf)"""

# ---------------------------------------------------------------- text


@query(rf"""SELECT doc_id, md5({_STRIP(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\d+\.\d+)-(\d)', '\1 - \2', 'g'), '(\d+\.\d+)-(\d)', '\1 - \2', 'g'), '(\d)([A-Za-z])', '\1 \2', 'g'), '([A-Za-z%])(\d)', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM documents""")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("digest"))


@query()
def normalized_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("digest"))


@query(f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_tokens FROM (SELECT doc_id, {_TOKENS("text")} AS w FROM documents)""")
def tokenize_counts(spark, sf_dir):
    w = X.tokenize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("tokens"), F.size(F.array_distinct(w)).cast("long").alias("distinct_tokens"))


@query(r"""WITH d AS (SELECT doc_id, lower(unnest(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{M}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{M}\p{N}_])([A-Z]{2,4})(?:$|[^\p{L}\p{M}\p{N}_])', 1))) AS token FROM documents), p AS (SELECT token, doc_id, count(*) AS n FROM d GROUP BY ALL),
t AS (SELECT token, CAST(sum(n) AS BIGINT) AS frequency, count(*) AS docs, max(n) AS most FROM p GROUP BY token HAVING sum(n) >= 2)
SELECT token, frequency, docs, round(most / frequency, 6) AS dominant, round(least(1.0, 0.3 + 0.5 * most / frequency + 0.02 * least(frequency, 25)), 3) AS confidence FROM t""")
def abbreviation_report(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select("doc_id", F.explode(X.short_tokens(F.col("text"))).alias("token"))
    return E.abbreviations(own)


@query(rf"""SELECT doc_id, CASE WHEN length(f) BETWEEN 6 AND 120 THEN f ELSE 'doc-' || doc_id END AS title FROM (SELECT doc_id, {_STRIP("string_split(text, chr(10))[1]")} AS f FROM documents)""")
def title_inference(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.title(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"))


@query(rf"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: {_STRIP("z")}), lambda z: z <> '') AS s FROM documents),
l AS (SELECT doc_id, text, list_filter(s, lambda z: len(regexp_split_to_array(z, '\s+')) >= 6) AS l FROM s),
h AS (SELECT doc_id, l, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda z: {_STRIP("z")}), lambda z: regexp_matches(z, '(?i)(p\s*=\s*[\d\.e-]+|auc|aupr|kl divergence|accuracy|precision|recall|baseline)'))[1:2] AS h FROM l)
SELECT doc_id, CASE WHEN len(l) > 0 THEN left(l[1], 280) WHEN len(h) > 0 THEN left(array_to_string(h, ' '), 280) END AS summary FROM h""")
def passage_summary(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.summary(F.col("text"), F.lit(False)).alias("summary"))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda z: length(z) >= 5))), ' ') AS terms FROM documents""")
def query_terms(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


@query(f"""SELECT item_id, array_to_string(list_filter({_TOKENS("text")}, lambda z: NOT list_contains({_LIST(V.QUERY_STOPWORDS)}, z) AND (length(z) >= 5 OR list_contains({_LIST(V.SHORT_TOKENS)}, z))), ' ') AS terms FROM benchmark""")
def informative_terms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.informative(X.tokenize(F.col("text")), "paper"), " ").alias("terms"))


@query(rf"""SELECT print, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha1({_STRIP(r"regexp_replace(lower(text), '\s+', ' ', 'g')")}) AS print FROM documents) GROUP BY print""")
def fingerprint_dedup(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("print")).groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# ---------------------------------------------------------------- passages and classes


_PARAGRAPHS = """d AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS raw FROM documents WHERE text IS NOT NULL),
pp AS (SELECT doc_id, list_filter(list_transform(raw, lambda z: regexp_replace(z, '^\\s+|\\s+$', '', 'g')), lambda z: z <> '') AS q FROM d)"""


@query(rf"""WITH RECURSIVE {_PARAGRAPHS},
step AS (SELECT doc_id, q, 0 AS j, CAST([] AS VARCHAR[]) AS buf, 0 AS n, CAST([] AS STRUCT(t VARCHAR, l VARCHAR)[]) AS done FROM pp
  UNION ALL SELECT doc_id, q, j + 1,
    CASE WHEN length(q[j + 1]) > 1700 THEN CAST([] AS VARCHAR[]) WHEN n + length(q[j + 1]) + 2 <= 1200 THEN list_append(buf, q[j + 1]) ELSE [q[j + 1]] END,
    CASE WHEN length(q[j + 1]) > 1700 THEN 0 WHEN n + length(q[j + 1]) + 2 <= 1200 THEN n + length(q[j + 1]) + 2 ELSE length(q[j + 1]) END,
    CASE WHEN length(q[j + 1]) <= 1700 AND n + length(q[j + 1]) + 2 <= 1200 THEN done
      ELSE list_concat(CASE WHEN len(buf) > 0 THEN list_append(done, struct_pack(t := array_to_string(buf, chr(10) || chr(10)), l := buf[-1])) ELSE done END,
        CASE WHEN length(q[j + 1]) > 1700 THEN list_transform(range(0, CAST(ceil(length(q[j + 1]) / 1700.0) AS BIGINT)), lambda i: struct_pack(t := {_STRIP("substring(q[j + 1], i * 1700 + 1, 1700)")}, l := {_STRIP("substring(q[j + 1], i * 1700 + 1, 1700)")})) ELSE CAST([] AS STRUCT(t VARCHAR, l VARCHAR)[]) END) END
  FROM step WHERE j < len(q)),
whole AS (SELECT doc_id, CASE WHEN len(buf) > 0 THEN list_append(done, struct_pack(t := array_to_string(buf, chr(10) || chr(10)), l := buf[-1])) ELSE done END AS c FROM step WHERE j = len(q)),
e AS (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM whole),
x AS (SELECT doc_id, i, c[i].t AS t, CASE WHEN i > 1 THEN c[i - 1].l ELSE '' END AS prev, length(c[i].t) > 0 AS some, c[i].t = c[i].l AND len(string_split(c[i].t, chr(10) || chr(10))) = 1 AS single FROM e),
m AS (SELECT doc_id, i, prev, CASE WHEN {_TABLE} THEN '[TABLE/FIGURE]' || chr(10) || t ELSE t END AS t FROM x)
SELECT doc_id, CAST(i - 1 AS INT) AS chunk_id, md5(CASE WHEN prev <> '' THEN {_STRIP("prev || chr(10) || chr(10) || t")} ELSE t END) AS digest FROM m""")
def chunk_paragraphs(spark, sf_dir):
    """Texts whose line feeds are doubled, so that each line is a paragraph: packing, the overlap, and longer paragraphs cut, whose pieces may be tables too."""
    docs = read(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return R.passages(docs, mark_cut=True).select("doc_id", "chunk_id", F.md5("text").alias("digest"))


@query(f"WITH {_PASSAGES} SELECT doc_id, chunk_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n FROM p")
def chunk_passages(spark, sf_dir):
    p = R.passages(read(spark, sf_dir, "documents"))
    return p.select("doc_id", "chunk_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query()
def annotated_passages(spark, sf_dir):
    p = R.annotate(R.passages(read(spark, sf_dir, "documents")))
    return p.select("doc_id", "chunk_id", "is_table_or_figure", F.round("noise_level", 6).alias("noise_level"), "chunk_type", "summary", F.size("short_tokens").alias("short_tokens"))


@query(rf"""WITH d AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, {_TABLE} AS is_table, round({_DIGITS("t")} / greatest(length(t), 1), 6) AS digit_share FROM d""")
def table_or_figure(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", C.is_table_or_figure(t).alias("is_table"), F.round(C.digits(t) / F.greatest(F.length(t), F.lit(1)), 6).alias("digit_share"))


_DOC_TYPE = lambda a, v: f"CASE WHEN {a} >= greatest(2, {v} + 1) THEN 'assembly' WHEN {v} >= greatest(2, {a} + 1) THEN 'variant' ELSE 'paper' END"


@query(f"""SELECT kind, count(*) AS n FROM (SELECT {_DOC_TYPE(_COUNT("b", V.DOC_TYPE_KEYWORDS["assembly"]), _COUNT("b", V.DOC_TYPE_KEYWORDS["variant"]))} AS kind FROM (SELECT lower(text) AS b FROM documents)) GROUP BY kind""")
def doc_type(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(C.doc_type(F.lit("doc"), F.lower("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- statistics and search


@query(f"WITH {_POSTINGS} SELECT term, df FROM df")
def document_frequency(spark, sf_dir):
    return _library(spark, sf_dir).df


@query(f"WITH {_POSTINGS} SELECT term, round(idf, 6) AS idf FROM idf")
def idf_weights(spark, sf_dir):
    return _library(spark, sf_dir).idf.select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {_POSTINGS} SELECT count(DISTINCT doc_id) AS total_docs, count(*) AS total_passages, round(avg(length), 6) AS avg_length FROM lens")
def corpus_stats(spark, sf_dir):
    return _library(spark, sf_dir).stats.withColumn("avg_length", F.round("avg_length", 6))


def _manifest(docs: DataFrame) -> dict[str, str]:
    """What a stored index must agree with: the files, the chunker, and the code that makes it."""
    return {"files": S_.state_of(docs), "chunker": f"{V.CHUNK_TARGET} {V.CHUNK_MOST} {V.CHUNK_OVERLAP}", "code": S_.code_of(X, C, V, R)}


def _library(spark, sf_dir) -> R.Library:
    """The stored index of the documents: built when a search first needs it, and again when their files or its code change."""
    docs = read(spark, sf_dir, "documents")
    tables = S_.kept(spark, "library", _manifest(docs), R.Library.of_documents(docs))
    return R.Library(None, tables)


def forget_library(spark, sf_dir) -> None:
    """Delete the stored index, so that the next search builds it."""
    S_.drop(spark, "library", _manifest(read(spark, sf_dir, "documents")))


@query(f"WITH {_BM25} SELECT query_id, doc_id, chunk_id, score, rank FROM bmr WHERE rank <= 10")
def bm25_batch(spark, sf_dir):
    lib = _library(spark, sf_dir)
    return R.search(asked(spark, sf_dir), lib, "bm25", 10).select("query_id", "doc_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} {_TFIDF} SELECT query_id, doc_id, chunk_id, score, rank FROM tfr WHERE rank <= 10")
def tfidf_cosine_topk(spark, sf_dir):
    lib = _library(spark, sf_dir)
    return R.search(asked(spark, sf_dir), lib, "tfidf", 10).select("query_id", "doc_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BM25} {_TFIDF}, runs AS (SELECT query_id, doc_id, chunk_id, rank FROM bmr WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, chunk_id, rank FROM tfr WHERE rank <= 10)
SELECT query_id, doc_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM runs GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    lib = _library(spark, sf_dir)
    runs = [R.search(asked(spark, sf_dir), lib, m, 10) for m in ("bm25", "tfidf")]
    return R.fuse(runs, ["doc_id", "chunk_id"])


_INNER = "round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])), 6)"


@query(f"""SELECT * FROM (SELECT b.vec_id AS query_id, a.vec_id, {_INNER} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_INNER} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) WHERE rank <= 10""")
def dense_batch(spark, sf_dir):
    """Every row whose id is divisible by 50 against all rows."""
    e = read(spark, sf_dir, "embeddings")
    asked_ = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_top(asked_, e.select("vec_id", "embedding"), 10).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


_LEX = r"""CASE WHEN len(qa) > 0 THEN len(list_intersect(qa, regexp_split_to_array(lower(d.text), '\s+'))) / len(qa) ELSE 0 END"""


@query(rf"""WITH {_BM25}, bq AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda z: length(z) > 2)) AS qa FROM benchmark)
SELECT b.query_id, b.doc_id, b.chunk_id, round(0.6 * coalesce(list_sum(list_transform(range(1, 65), lambda i: CAST(x.embedding[i] AS DOUBLE) * y.embedding[i])), 0) + 0.4 * ({_LEX}), 6) AS score
FROM bmr b JOIN p d USING (doc_id, chunk_id) JOIN bq USING (query_id) LEFT JOIN embeddings x ON x.vec_id = b.doc_id LEFT JOIN embeddings y ON y.vec_id = b.query_id WHERE rank <= 10""")
def rerank(spark, sf_dir):
    """The vector of a document's number is that of its passages, and that of a query's number asks."""
    lib = _library(spark, sf_dir)
    e, q = read(spark, sf_dir, "embeddings"), asked(spark, sf_dir)
    best = R.search(q, lib, "bm25", 10).join(q, "query_id").join(lib.passages, ["doc_id", "chunk_id"])
    both = best.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("a")), "doc_id", "left").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("b")), "query_id", "left")
    score = R.rerank_score(F.coalesce(R.inner_product(F.col("a"), F.col("b")), F.lit(0.0)), R.lexical_overlap(F.col("query"), F.col("text")), F.lit(0.0), F.lit(False))
    return both.select("query_id", "doc_id", "chunk_id", F.round(score, 6).alias("score"))


@query(f"""WITH {_BM25}, bq AS (SELECT item_id AS query_id, list_distinct({_TOKENS("text")}) AS qa FROM benchmark)
SELECT query_id, doc_id, chunk_id, round(len(list_filter(qa, lambda z: contains(lower(p.text), z))) / len(qa), 6) AS overlap FROM bmr JOIN p USING (doc_id, chunk_id) JOIN bq USING (query_id) WHERE rank <= 10""")
def query_overlap(spark, sf_dir):
    lib = _library(spark, sf_dir)
    best = R.search(asked(spark, sf_dir), lib, "bm25", 10).join(asked(spark, sf_dir), "query_id").join(lib.passages, ["doc_id", "chunk_id"])
    return best.select("query_id", "doc_id", "chunk_id", F.round(X.overlap(X.tokenize(F.col("query")), F.lower("text")), 6).alias("overlap"))


def _candidates(spark, sf_dir, k: int) -> DataFrame:
    lib = _library(spark, sf_dir)
    q = asked(spark, sf_dir).withColumn("query", X.rewrite(F.col("query"), F.lit("paper")))
    # Only the candidates are annotated: their texts are joined back after the ranking.
    best = R.annotate(R.search(q, lib, "bm25", 3 * k).join(q, "query_id").join(lib.passages, ["doc_id", "chunk_id"]))
    target = F.array(F.col("query_id") % 7)
    return best.select(
        "query_id", F.col("rank").alias("pos"), "score", X.tokenize(F.col("query")).alias("terms"), target.alias("targets"), "doc_id", "chunk_id", "text", "summary", "chunk_type",
        F.lit("paper").alias("doc_type"), "is_table_or_figure", "noise_level", F.lit(False).alias("has_metrics"), M.runtime_signal(F.col("raw_text")).alias("runtime_signal"),
    )


@query()
def quality_filter(spark, sf_dir):
    return Q.select(Q.scored(_candidates(spark, sf_dir, 6), "paper"), 6)


@query()
def filter_trace(spark, sf_dir):
    c = Q.scored(_candidates(spark, sf_dir, 6), "paper")
    return c.select("query_id", "doc_id", "chunk_id", F.round("adjusted", 6).alias("adjusted"), F.round("penalty", 6).alias("penalty"), F.round("overlap", 6).alias("overlap"), "gate")


# ---------------------------------------------------------------- the whole chain


def _dense(spark, sf_dir, k: int):
    """(the dense run, similarity of candidates): the vector of a query's number asks, that of a document's number is its first passage's."""
    e, q = read(spark, sf_dir, "embeddings"), asked(spark, sf_dir)
    own = e.join(R.small(q.select(F.col("query_id").alias("vec_id"))), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    run = R.dense_top(own, e.select("vec_id", "embedding"), k).select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_id"), "score", "rank")

    def similarity(pool: DataFrame) -> DataFrame:
        of_query = own.withColumnRenamed("embedding", "a")
        of_doc = e.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.col("embedding").alias("b"))
        both = pool.join(of_query, "query_id", "left").join(of_doc, ["doc_id", "chunk_id"], "left")
        return both.select("query_id", "doc_id", "chunk_id", R.inner_product(F.col("a"), F.col("b")).alias("sem"))

    return run, similarity


def _collected(spark, sf_dir, named: bool, k: int = 6):
    lib, q = _library(spark, sf_dir), asked(spark, sf_dir)
    run, similarity = _dense(spark, sf_dir, k)
    targets = q.select("query_id", F.col("query_id").alias("doc_id")).where(F.lit(named))  # the document of a query's number
    write = lambda df, name: S_.written(df, f"hybrid-{name}")
    return q, targets, *H.collect(q, lib, targets, similarity, run, "bm25", "paper", k, write)


@query(rf"""WITH {_BM25} {_TFIDF},
dn AS (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, 0 AS chunk_id, {_INNER} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_INNER} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark)),
runs AS (SELECT query_id, 'primary' AS stage, doc_id, chunk_id, score, rank FROM bmr WHERE rank <= 6 UNION ALL SELECT query_id, 'fallback', doc_id, chunk_id, score, rank FROM tfr WHERE rank <= 6 UNION ALL SELECT query_id, 'dense', doc_id, chunk_id, score, rank FROM dn WHERE rank <= 6),
fs AS (SELECT query_id, doc_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM runs GROUP BY ALL),
fr AS (SELECT query_id, 'fused' AS stage, doc_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM fs),
bq AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda z: length(z) > 2)) AS qa FROM benchmark),
ov AS (SELECT fs.query_id, fs.doc_id, fs.chunk_id, {_LEX} AS lex, CASE WHEN starts_with(d.text, '[TABLE/FIGURE]') THEN 0.9 ELSE 1.0 END AS keep FROM fs JOIN p d USING (doc_id, chunk_id) JOIN bq USING (query_id)),
sm AS (SELECT ov.*, CASE WHEN chunk_id = 0 THEN list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])) END AS sem FROM ov LEFT JOIN embeddings a ON a.vec_id = doc_id LEFT JOIN embeddings b ON b.vec_id = query_id),
rs AS (SELECT query_id, doc_id, chunk_id, (0.6 * coalesce(sem, 0) + (1 - 0.6) * lex) * keep AS score FROM sm),
rr AS (SELECT query_id, 'reranked' AS stage, doc_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM rs)
SELECT * FROM runs UNION ALL SELECT * FROM fr UNION ALL SELECT * FROM rr WHERE rank <= 12""")
def hybrid_stages(spark, sf_dir):
    """All runs of queries that name no document, up to the reranked candidates."""
    _, _, stages, _, _ = _collected(spark, sf_dir, False)
    return H.by_stage({n: stages[n] for n in ("primary", "fallback", "dense", "fused", "reranked")})


@query()
def hybrid_collect(spark, sf_dir):
    """Every stage where each query names a document. Its targets are the documents that the dense run asks with, so no seed is needed; ``review_stages`` has those."""
    return H.by_stage(_collected(spark, sf_dir, True)[2])


@query()
def filter_decisions(spark, sf_dir):
    """What becomes of each reranked candidate, and why."""
    return _collected(spark, sf_dir, True)[3].select("query_id", "doc_id", "chunk_id", "final_rank", "reason")


def _synthesis(spark, sf_dir) -> DataFrame:
    q, targets, _, _, final = _collected(spark, sf_dir, True)
    kept = final.select("query_id", F.col("final_rank").alias("rank"), "doc_id", "chunk_id", "text", "summary", "chunk_type", "n_metrics")
    records = final.select("query_id", "final_rank", "doc_id", "chunk_id", F.posexplode("records").alias("at", "r"))
    records = records.select("query_id", (F.col("final_rank") * 10000 + F.col("at")).alias("pos"), "r.label", "r.value", "r.model", "r.dataset", "doc_id", "chunk_id")
    return Y.build(q, kept, records, targets)


@query()
def structured_build(spark, sf_dir):
    s = _synthesis(spark, sf_dir)
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), " | ")
    return s.select("query_id", "status", names("claims", "statement").alias("claims"), names("unsupported", "topic").alias("unsupported"), F.array_join("limitations", " | ").alias("limitations"), F.array_join("conflicts", " | ").alias("conflicts"), "total_passages", "metric_candidates")


@query()
def verify_claims(spark, sf_dir):
    """Claims of every fifth query lose their citation, and the verifier drops them."""
    s = _synthesis(spark, sf_dir)
    bare = F.transform("claims", lambda c: c.withField("doc_id", F.when(F.col("query_id") % 5 != 0, c["doc_id"])))
    return Y.verify(s.withColumn("claims", bare)).select("query_id", "status", F.size("claims").alias("claims"), F.size("unsupported").alias("unsupported"), "dropped")


@query()
def structured_page(spark, sf_dir):
    return Y.page(Y.verify(_synthesis(spark, sf_dir)))


@query(f"""WITH {_BM25}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS n FROM bmr WHERE rank <= 20) SELECT query_id, doc_id, chunk_id FROM best WHERE n <= 3""")
def per_doc_quota(spark, sf_dir):
    lib = _library(spark, sf_dir)
    best = R.search(asked(spark, sf_dir), lib, "bm25", 20).withColumn("own", F.concat_ws(":", "query_id", "doc_id"))
    return E.recent(best.drop("rank").withColumn("by", -F.col("score")), "own", [F.col("by"), F.col("chunk_id")], 3).select("query_id", "doc_id", "chunk_id")


_KEYED = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH b AS (SELECT item_id AS query_id, text, row_number() OVER (ORDER BY item_id) AS n FROM benchmark),
d AS (SELECT item_id AS doc_id, CASE WHEN item_id % 3 = 0 THEN left(text, 60) ELSE 'untitled' END AS title, '10.' || (5000 + item_id) || '/x' || item_id AS doi, split_part(text, ' ', 2) AS alias FROM benchmark),
q AS (SELECT query_id, {_KEYED("CASE WHEN query_id % 4 = 0 THEN text || ' see 10.' || (5000 + query_id) || '/X' || query_id WHEN query_id % 4 = 1 THEN 'what does this long awaited paper say of ' || split_part(text, ' ', 2) ELSE text END")} AS t, query_id % 4 = 1 AS deictic FROM b),
s AS (SELECT query_id, deictic, doc_id, 2 AS s FROM q, d WHERE (length({_KEYED("title")}) >= 8 AND contains(t, {_KEYED("title")})) OR contains(t, {_KEYED("doi")})
  UNION ALL SELECT query_id, deictic, doc_id, 1 FROM q, d WHERE length({_KEYED("alias")}) >= 4 AND contains(t, {_KEYED("alias")})),
g AS (SELECT query_id, deictic, doc_id, max(s) AS s FROM s GROUP BY ALL)
SELECT query_id, doc_id, CASE WHEN s = 2 THEN 'strong' ELSE 'weak' END AS strength FROM g WHERE s = (SELECT max(s) FROM g h WHERE h.query_id = g.query_id) AND (s = 2 OR NOT deictic)""")
def target_inference(spark, sf_dir):
    """Documents with titles, DOIs and aliases made of the benchmark's texts, which queries name in each of these ways."""
    b = read(spark, sf_dir, "benchmark")
    number, second = F.col("item_id").cast("string"), F.split_part("text", F.lit(" "), F.lit(2))
    doi = F.concat(F.lit(" see 10."), (F.col("item_id") + 5000).cast("string"), F.lit("/X"), number)
    query = F.when(F.col("item_id") % 4 == 0, F.concat("text", doi)).when(F.col("item_id") % 4 == 1, F.concat(F.lit("what does this long awaited paper say of "), second)).otherwise(F.col("text"))
    title = F.when(F.col("item_id") % 3 == 0, F.left("text", F.lit(60))).otherwise("untitled")
    docs = b.select(F.col("item_id").alias("doc_id"), title.alias("title"), F.concat(F.lit("10."), (F.col("item_id") + 5000).cast("string"), F.lit("/x"), number).alias("text"), F.array(second).alias("aliases"))
    return R.infer_targets(b.select(F.col("item_id").alias("query_id"), query.alias("query")), docs)


@query("""SELECT DISTINCT c.conv_id, c.turn, c.role FROM conversations c JOIN conversations u ON u.conv_id = c.conv_id AND abs(u.turn - c.turn) <= 1 WHERE u.role = 'assistant'""")
def neighbour_expand(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return R.neighbours(c, c.where("role = 'assistant'"), 1, "conv_id", "turn").select("conv_id", "turn", "role").distinct()


@query(f"""WITH {_BM25} SELECT query_id, md5(string_agg('[CITE doc=' || doc_id || ' no-page chunk=' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM bmr JOIN p USING (doc_id, chunk_id) WHERE rank <= 6 GROUP BY query_id""")
def evidence_block(spark, sf_dir):
    lib = _library(spark, sf_dir)
    best = R.search(asked(spark, sf_dir), lib, "bm25", 6).join(lib.passages, ["doc_id", "chunk_id"])
    return R.evidence_block(best).select("query_id", F.md5("block").alias("digest"))


# ---------------------------------------------------------------- metrics, claims, variants


def _metric_text(spark, sf_dir) -> DataFrame:
    text = F.format_string("Model %s on gnomAD. Accuracy: %.2f; AUC = %.2f and p = %.3f", "p_brand", F.col("p_retailprice") / 2000, F.col("p_retailprice") % 1, F.col("p_size") / 100)
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query()
def metric_extract(spark, sf_dir):
    return _metric_text(spark, sf_dir).select("p_partkey", F.explode(M.extract_metrics(F.col("text"))).alias("m")).select("p_partkey", "m.label", "m.value", "m.unit", "m.model", "m.dataset", "m.task")


@query("""SELECT 'Accuracy' AS label, p_partkey, p_retailprice <= 100 AS ok FROM part UNION ALL SELECT 'p-value', p_partkey, p_size / 10.0 <= 1 FROM part UNION ALL SELECT 'doi', p_partkey, false FROM part""")
def metric_meaningful(spark, sf_dir):
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    rows = F.array(row("Accuracy", F.col("p_retailprice")), row("p-value", F.col("p_size") / 10.0), row("doi", F.lit(0.5)))
    m = read(spark, sf_dir, "part").select("p_partkey", F.explode(rows).alias("m"))
    return m.select("m.label", "p_partkey", M.meaningful(F.col("m.label"), F.col("m.value"), F.lit(""), F.lit("")).alias("ok"))


@query("""SELECT lower(p_brand) AS label, lower(p_type) AS dataset, count(DISTINCT CAST(p_size AS VARCHAR)) AS n_values, min(CAST(p_size AS VARCHAR)) AS lowest, max(CAST(p_size AS VARCHAR)) AS highest FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1""")
def metric_conflicts(spark, sf_dir):
    return S.metric_conflicts(read(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("dataset"), F.col("p_size").cast("string").alias("value")))


_POS, _NEG = ["the", "est"], ["der", "los"]


@query(f"""WITH c AS (SELECT conv_id AS query_id, turn AS pos, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'est') THEN 1 WHEN contains(lower(text), 'der') OR contains(lower(text), 'los') THEN -1 ELSE 0 END AS s, {_TOKENS("text")} AS t FROM conversations)
SELECT a.query_id, a.pos AS a, b.pos AS b FROM c a JOIN c b ON a.query_id = b.query_id AND a.pos < b.pos AND a.s * b.s < 0 AND len(list_intersect(a.t, b.t)) > 0""")
def narrative_conflicts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), S.sentiment(F.col("text"), _POS, _NEG).alias("sentiment"), F.array_distinct(X.tokenize(F.col("text"))).alias("tokens"))
    return S.narrative_conflicts(c)


@query(f"""WITH {_BM25}, k AS (SELECT query_id, doc_id, lower(text) AS low FROM bmr JOIN p USING (doc_id, chunk_id) WHERE rank <= 5),
t AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda z: length(z) >= 5))) AS term FROM benchmark),
miss AS (SELECT query_id, string_agg(term, ',' ORDER BY term) AS missing FROM t WHERE term NOT IN ('paper', 'document', 'article', 'manuscript') AND NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = t.query_id AND contains(low, term)) GROUP BY query_id)
SELECT item_id AS query_id, (SELECT count(*) FROM k WHERE k.query_id = item_id) AS total_passages, coalesce(missing, '') AS missing_terms FROM benchmark LEFT JOIN miss ON miss.query_id = item_id""")
def coverage_report(spark, sf_dir):
    lib = _library(spark, sf_dir)
    kept = R.search(asked(spark, sf_dir), lib, "bm25", 5).join(lib.passages, ["doc_id", "chunk_id"]).select("query_id", "doc_id", "text", F.lit(None).cast("string").alias("summary"), F.lit("body").alias("chunk_type"), F.lit(0).alias("n_metrics"))
    return S.coverage(kept, asked(spark, sf_dir)).select("query_id", "total_passages", "missing_terms")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN d.doc_id % 5 = 0 AND quality = 0 THEN 'insufficient_evidence' WHEN n > 0 AND d.doc_id % 3 = 0 AND d.doc_id % 4 <> 0 AND d.doc_id % 2 = 0 THEN 'off_target_evidence'
 WHEN d.doc_id % 3 = 0 AND d.doc_id % 2 <> 0 AND d.doc_id % 7 = 0 AND d.doc_id % 5 <> 0 THEN 'insufficient_evidence' WHEN d.doc_id % 3 = 0 AND d.doc_id % 2 <> 0 THEN 'off_target_evidence'
 WHEN n > 0 AND toxic >= n THEN 'partially_supported' WHEN n > 0 AND quality = 1 AND d.doc_id % 11 = 0 THEN 'conflicting_evidence' WHEN n > 0 THEN 'supported' ELSE 'insufficient_evidence' END AS status
 FROM (SELECT doc_id, n_chars // 1000 AS n FROM documents) d JOIN labels USING (doc_id)) GROUP BY status""")
def audit_status(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 1000).alias("n")).join(read(spark, sf_dir, "labels"), "doc_id")
    i = F.col("doc_id")
    status = S.audit(F.col("n"), F.col("toxic"), i % 3 == 0, i % 2 == 0, i % 4 == 0, i % 5 == 0, F.col("quality"), F.when((F.col("quality") == 1) & (i % 11 == 0), 1).otherwise(0), i % 7 == 0)
    return d.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def _variant_text(spark, sf_dir) -> DataFrame:
    """One text of each part: brands stand in for genes, sizes for positions and counts, types for classes."""
    kind = F.element_at(F.array(*map(F.lit, V.CLINVAR)), (F.crc32("p_type") % len(V.CLINVAR) + 1).cast("int"))
    text = F.format_string("GENE%s c.%dA>T variant in ClinVar: %s. %d cases of European ancestry, gnomAD 0.%d", F.regexp_extract("p_brand", r"(\d+)", 1), F.col("p_size"), kind, F.col("p_size") + 1, F.col("p_partkey") % 90 + 10)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"), (F.col("p_partkey") % 2).cast("int").alias("n_metrics"), F.lit("variant").alias("doc_type"))


@query()
def variant_fields(spark, sf_dir):
    v = S.variant_fields(_variant_text(spark, sf_dir))
    return v.withColumn("confidence", F.round(S.variant_confidence(v), 6)).drop("text")


_CLASSES = ["Pathogenic", "Likely benign", "Benign", "VUS", "Likely pathogenic"]


@query(f"""WITH k AS (SELECT 'c.' || p_size || 'a>t' AS variant, CASE p_partkey % 5 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely benign' WHEN 2 THEN 'Benign' WHEN 3 THEN 'Variant of uncertain significance' ELSE 'Likely pathogenic' END AS label FROM part WHERE p_size % 7 <> 0 OR p_partkey % 5 = 2)
SELECT variant, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM k GROUP BY variant HAVING count(DISTINCT label) > 1""")
def variant_conflicts(spark, sf_dir):
    """One text of each part: its size is the variant's position, its number the class; texts of some sizes name one class only."""
    kind = F.get(F.array(*map(F.lit, _CLASSES)), (F.col("p_partkey") % 5).cast("int"))
    said = F.when((F.col("p_size") % 7 != 0) | (F.col("p_partkey") % 5 == 2), kind).otherwise("not told")
    text = F.concat(F.lit("GENE1 c."), F.col("p_size").cast("string"), F.lit("A>T classification in ClinVar: "), said)
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"), F.lit(0).alias("n_metrics"), F.lit("variant").alias("doc_type"))
    return S.variant_conflicts(S.variant_fields(rows))


@query(rf"""WITH l AS (SELECT page_id, unnest(string_split(replace(url, '/', chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(url, '/', chr(10)), chr(10)), 1) - 1 AS pos FROM pages)
SELECT page_id, CAST(pos AS INT) AS pos, {_STRIP("substring(line, 1, instr(line, ':') - 1)")} AS name, {_STRIP("substring(line, instr(line, ':') + 1)")} AS value FROM l WHERE contains(line, ':') AND length(line) < 120""")
def assembly_lines(spark, sf_dir):
    return S.assembly_lines(read(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("/"), F.lit("\n")).alias("text")), "page_id")


# ---------------------------------------------------------------- evaluation and state

_WORDS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '([a-z0-9]+)', 1), lambda z: length(z) > 2))"


@query(f"""WITH c AS (SELECT a.conv_id, a.turn, {_WORDS("a.text")} AS x, {_WORDS("b.text")} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
s AS (SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN len(list_intersect(x, y)) / len(x) ELSE 0 END AS s FROM c) SELECT conv_id, turn, round(s, 6) AS coverage, CASE WHEN s >= 0.6 THEN 5 WHEN s >= 0.3 THEN 3 ELSE 1 END AS score FROM s""")
def groundedness(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    share, score = S.groundedness(F.col("text"), F.col("evidence"))
    return c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(share, 6).alias("coverage"), score.alias("score"))


@query(r"""SELECT role, round(least(1.0, avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda z: z <> ''))) / 200), 6) AS faithfulness, round(1 - least(1.0, avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda z: z <> ''))) / 200), 6) AS unsupported_rate, count(*) AS n FROM conversations GROUP BY role""")
def answer_eval(spark, sf_dir):
    return E.answer_eval(read(spark, sf_dir, "conversations"), "role")


@query("""SELECT item_id, least(1.0, len(string_split(text, '.')) / 5.0) AS precision_at_k FROM benchmark""")
def retrieval_eval(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.least(F.lit(1.0), F.size(F.split("text", r"\.")) / 5).alias("precision_at_k"))


@query("""SELECT event_type, round(median(value), 6) AS p50, round(list_sort(list(value))[CAST(floor(0.95 * (count(value) - 1)) AS BIGINT) + 1], 6) AS p95, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_stats(spark, sf_dir):
    return E.latency(read(spark, sf_dir, "events"), "event_type", "value")


_VALIDATION = "SELECT doc_id, lang AS task_type, source AS slug, quality = 1 AS passed, CASE WHEN toxic = 1 THEN 'off_target_evidence' ELSE 'supported' END AS status FROM labels JOIN documents USING (doc_id)"


def _validation(spark, sf_dir) -> DataFrame:
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").drop("text"), "doc_id")
    return both.select("doc_id", F.col("lang").alias("task_type"), F.col("source").alias("slug"), (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "off_target_evidence").otherwise("supported").alias("status"))


@query(f"""SELECT coalesce(task_type, 'all') AS task_type, count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 6) AS rate FROM ({_VALIDATION}) GROUP BY ROLLUP (task_type)""")
def validation_summary(spark, sf_dir):
    return E.validation_summary(_validation(spark, sf_dir))


@query(f"""WITH r AS ({_VALIDATION}), f AS (SELECT * FROM r WHERE NOT passed)
SELECT 'task_type' AS dimension, task_type AS value, count(*) AS failures FROM f GROUP BY 2 UNION ALL SELECT 'slug', slug, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY 2""")
def failure_breakdown(spark, sf_dir):
    return E.failure_breakdown(_validation(spark, sf_dir))


@query(f"""WITH r AS ({_VALIDATION}), k AS (SELECT doc_id // 2 AS key, doc_id % 2 AS side, passed FROM r), a AS (SELECT key, passed AS a FROM k WHERE side = 0), b AS (SELECT key, passed AS b FROM k WHERE side = 1)
SELECT key, CASE WHEN NOT a AND b THEN 'fixed' WHEN a AND NOT b THEN 'regressed' ELSE 'unchanged_fail' END AS change FROM a JOIN b USING (key) WHERE NOT (a AND b)""")
def report_compare(spark, sf_dir):
    r = _validation(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).alias("key"), F.col("doc_id").alias("pos"), "passed")
    return E.compare(r.where("pos % 2 = 0"), r.where("pos % 2 = 1"))


@query(f"""SELECT t.tag, coalesce(n, 0) AS n FROM (VALUES ('en'), ('de'), ('xx')) t(tag) LEFT JOIN (SELECT lang AS tag, count(*) AS n FROM documents GROUP BY 1) USING (tag)""")
def corpus_tag_counts(spark, sf_dir):
    return E.tag_counts(read(spark, sf_dir, "documents").select(F.array("lang").alias("tags")), "tags", ["en", "de", "xx"])


@query("""SELECT 'doc-' || d.doc_id AS slug, d.doc_id % 2 = 0 AS file_present, CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS n_indexed, CASE WHEN l.doc_id IS NOT NULL THEN 'skip' WHEN d.doc_id % 2 = 0 THEN 'ingest' ELSE 'download' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""")
def corpus_status(spark, sf_dir):
    d, name = read(spark, sf_dir, "documents"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    manifest = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), name.alias("filename"))
    indexed = read(spark, sf_dir, "labels").select(F.concat(F.lit("/lib/"), name).alias("source_path"), "doc_id")
    return E.corpus_status(manifest, indexed, d.where("doc_id % 2 = 0").select(F.concat(F.lit("/files/"), name).alias("path")))


@query("""SELECT conv_id, CAST(min(turn) AS BIGINT) AS created, max(turn) AS updated, arg_max(md5(text), turn) AS digest FROM conversations GROUP BY conv_id""")
def session_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("created"), F.col("turn").alias("updated"), F.md5("text").alias("digest"))
    return E.upsert(c.where("updated < 1"), c.where("updated >= 1"), "conv_id", "created", "updated")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5""")
def recent_items(spark, sf_dir):
    return E.recent(read(spark, sf_dir, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id")


@query("""SELECT user_id, max(event_id) AS last_used, count(*) AS hits FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 128""")
def lru_cache(spark, sf_dir):
    return E.lru(read(spark, sf_dir, "events"), "user_id", "event_id", 128)


@query(r"""WITH s AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'no citations' WHEN regexp_matches(text, '(?i)(Nature.*\d{3,4}|Science.*\d{3,4}|Cell.*\d{3,4})') THEN 'possible hallucination' ELSE 'ok' END AS verdict FROM s""")
def citation_guard(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", S.citation_guard(F.col("text"), F.lit(True), F.col("turn") % 2 == 0, F.array(F.lit("1:0"))).alias("verdict"))


@query(f"""WITH d AS (SELECT DISTINCT source AS slug FROM documents), t AS (SELECT unnest({_LIST(L.TASKS)}) AS task_type), x AS (SELECT slug || '-' || replace(task_type, '_', '-') AS id, slug, task_type FROM d, t) SELECT id, slug, task_type FROM x WHERE slug <> 'src1'""")
def draft_items(spark, sf_dir):
    papers = read(spark, sf_dir, "documents").select(F.col("source").alias("slug")).distinct()
    old = E.draft_items(papers.where("slug = 'src1'"), spark.createDataFrame([], "id string"), L.TASKS)
    return E.draft_items(papers, old, L.TASKS)


@query("""SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL""")
def library_listing(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# ---------------------------------------------------------------- commands, seeds, claims, probes


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'search' WHEN turn % 3 = 1 THEN 'cite' ELSE 'chat' END AS command, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN CAST(turn AS VARCHAR) ELSE 'so ' || role END AS args FROM conversations""")
def command_parse(spark, sf_dir):
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Look for "), "role")).when(F.col("turn") % 3 == 1, F.concat(F.lit(" cite result "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("so "), "role"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", D.command(line).alias("c")).select("conv_id", "turn", "c.command", "c.args")


@query()
def previews(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", D.preview(F.col("text")).alias("preview"), F.array_join(D.metric_sentences(F.col("text")), " | ").alias("metrics"))


_OVER = lambda terms, low: f"(len(list_filter({terms}, lambda z: contains({low}, z))) / len({terms}))"


@query(f"""WITH q AS (SELECT item_id AS query_id, list_distinct({_TOKENS("text")}) AS t FROM benchmark),
i AS (SELECT *, list_filter(t, lambda z: NOT list_contains({_LIST(V.QUERY_STOPWORDS)}, z) AND (length(z) >= 5 OR list_contains({_LIST(V.SHORT_TOKENS)}, z))) AS info FROM q),
s AS (SELECT query_id, doc_id, {_OVER("t", "lower(text)")} AS o, CASE WHEN len(info) > 0 THEN {_OVER("info", "lower(text)")} END AS f FROM i, documents)
SELECT query_id, doc_id, round(0.7 * o + 0.3 * coalesce(f, o), 6) AS score FROM s WHERE o >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * o + 0.3 * coalesce(f, o), 6) DESC, doc_id) <= 2""")
def target_seed(spark, sf_dir):
    """Every query against every document."""
    q = asked(spark, sf_dir).select("query_id", F.array_distinct(X.tokenize(F.col("query"))).alias("terms"))
    c = P.seed_candidates(read(spark, sf_dir, "documents").select("doc_id", "text"), q)
    c = c.select("*", F.lit(False).alias("found_target"), F.lit(0).alias("chunk_id"), F.lit(None).cast("string").alias("summary"), F.lit("body").alias("chunk_type"), F.lit("paper").alias("doc_type"), F.lit(False).alias("is_table_or_figure"), F.lit(0.0).alias("noise_level"), F.lit(False).alias("has_metrics"))
    return P.target_seeds(c).select("query_id", "doc_id", "score")


@query()
def structured_claims(spark, sf_dir):
    lib = _library(spark, sf_dir)
    best = R.search(asked(spark, sf_dir), lib, "bm25", 6).join(lib.passages, ["doc_id", "chunk_id"])
    kept = best.select("query_id", "rank", "doc_id", "chunk_id", "text", X.summary(F.col("text"), F.lit(False)).alias("summary"), F.lit("body").alias("chunk_type"), F.lit(0).alias("n_metrics"))
    claims = P.claims(kept)
    cover = S.coverage(kept, asked(spark, sf_dir))
    status = cover.select("query_id", F.when(F.col("total_passages") == 0, "insufficient_evidence").when(F.size(F.split("missing_terms", ",")) >= 3, "partially_supported").otherwise("supported").alias("status"))
    return P.render(claims, cover, status)


@query()
def variant_coverage(spark, sf_dir):
    v = S.variant_fields(_variant_text(spark, sf_dir))
    return P.variant_coverage(v.withColumn("query_id", F.col("doc_id") % 2))


_PROBES = "SELECT source AS slug, text AS query, quality = 1 AS inferred, toxic = 0 AS overlapping, doc_id % 50 = 0 AS blocked, CASE WHEN doc_id % 50 = 0 THEN ['expected_doc_type_mismatch:' || lang] ELSE [] END AS reasons, CASE WHEN doc_id % 3 = 0 THEN 'insufficient_evidence' ELSE 'supported' END AS status FROM labels JOIN documents USING (doc_id)"


def _probes(spark, sf_dir) -> DataFrame:
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    bad = F.col("doc_id") % 50 == 0
    return both.select(
        F.col("source").alias("slug"), F.col("text").alias("query"), (F.col("quality") == 1).alias("inferred"), (F.col("toxic") == 0).alias("overlapping"), bad.alias("blocked"),
        F.when(bad, F.array(F.concat(F.lit("expected_doc_type_mismatch:"), "lang"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.when(F.col("doc_id") % 3 == 0, "insufficient_evidence").otherwise("supported").alias("status"),
    )


@query(f"""WITH r AS ({_PROBES}), x AS (SELECT slug, string_agg(DISTINCT z, ';' ORDER BY z) AS reasons FROM (SELECT slug, unnest(reasons) AS z FROM r) GROUP BY slug)
SELECT r.slug, count(*) AS queries, count(*) FILTER (inferred) AS inferred, count(*) FILTER (overlapping) AS overlapping, bool_or(blocked) AS blocked, coalesce(any_value(x.reasons), '') AS reasons FROM r LEFT JOIN x USING (slug) GROUP BY r.slug""")
def probe_integrity(spark, sf_dir):
    return P.probe_integrity(_probes(spark, sf_dir))


@query(f"""WITH r AS ({_PROBES}) SELECT 'target_inference_failure' AS failure, count(*) FILTER (NOT inferred) AS n FROM r UNION ALL SELECT 'doc_type_mode_mismatch', count(*) FILTER (len(reasons) > 0) FROM r UNION ALL SELECT 'retrieval_filtering_failure', count(*) FILTER (inferred AND NOT overlapping) FROM r
UNION ALL SELECT 'query_phrasing_issue', count(*) FILTER (contains(lower(query), 'this ') AND NOT inferred) FROM r UNION ALL SELECT 'genuine_evidence_absence', count(*) FILTER (status = 'insufficient_evidence' AND overlapping) FROM r""")
def probe_failures(spark, sf_dir):
    return P.probe_failures(_probes(spark, sf_dir))


@query(f"""WITH r AS ({_VALIDATION}) SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY status""")
def report_summary(spark, sf_dir):
    return P.report_summary(_validation(spark, sf_dir))


# ---------------------------------------------------------------- the catalogue


_RUNS3 = "list_distinct(list_filter(regexp_extract_all(lower({}), '([a-z0-9]+)', 1), lambda z: length(z) >= 3))"


@query(f"""WITH a AS (SELECT item_id, list_slice(list_sort({_RUNS3.format("text")}), 1, 2) AS w FROM benchmark), d AS (SELECT doc_id, {_RUNS3.format("text")} AS v FROM documents)
SELECT item_id, count(*) AS docs FROM a JOIN d ON len(w) > 0 AND len(list_filter(w, lambda z: NOT list_contains(v, z))) = 0 GROUP BY item_id""")
def alias_subset(spark, sf_dir):
    """In how many documents all words of an alias occur: aliases and texts meet on an alias's first word."""
    a = read(spark, sf_dir, "benchmark").select("item_id", F.slice(F.array_sort(K.alias_tokens(F.col("text"))), 1, 2).alias("w")).where(F.size("w") > 0)
    d = read(spark, sf_dir, "documents").select("doc_id", K.alias_tokens(F.col("text")).alias("v"))
    words = R.small(a.select(F.explode("w").alias("word")).distinct())
    held = d.select("doc_id", F.explode("v").alias("word")).join(words, "word")  # words of aliases only
    both = a.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word")).join(held, "word").groupBy("item_id", "n", "doc_id").agg(F.count("*").alias("hits")).where("hits = n")
    return both.groupBy("item_id").agg(F.count("*").alias("docs"))


@query(rf"""SELECT conv_id, turn, contains(lower(text), 'library') OR contains(lower(text), 'paper') OR contains(lower(text), 'document') OR contains(lower(text), 'pdfs') AS overview,
 contains(regexp_replace(lower(text || ' what are the papers'), '\s+', ' ', 'g'), 'what are') AND contains(lower(text || ' what are the papers'), 'paper') AS topic FROM conversations""")
def question_intents(spark, sf_dir):
    asked_ = F.concat("text", F.lit(" what are the papers"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", K.asks_for_overview(F.col("text")).alias("overview"), K.asks_for_topic(asked_).alias("topic"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.45 WHEN event_id % 3 = 1 THEN 0.6 ELSE 0.7 END AS confidence, left(sha1(lower(event_type || user_id)), 10) AS print FROM events""")
def metric_trust(spark, sf_dir):
    i = F.col("event_id") % 3
    return read(spark, sf_dir, "events").select("event_id", K.metric_confidence(i == 1, i == 0).alias("confidence"), K.context_hash(F.concat("event_type", F.col("user_id").cast("string"))).alias("print"))


@query("""WITH m AS (SELECT source || '.txt' AS name, list_sort(list_distinct(list(lang))) AS tags FROM documents GROUP BY 1) SELECT s_suppkey AS doc_id, coalesce(array_to_string(tags, ','), '') AS scope_aliases FROM supplier LEFT JOIN m ON name = 'src' || (s_suppkey % 30) || '.txt'""")
def scope_join(spark, sf_dir):
    """Suppliers stand in for indexed files, sources for files of the manifest."""
    manifest = read(spark, sf_dir, "documents").select(F.concat(F.lit("a/b/"), "source", F.lit(".txt")).alias("filename"), F.array("lang").alias("scope_aliases"))
    path = F.concat(F.lit("/lib/src"), (F.col("s_suppkey") % 30).cast("string"), F.lit(".txt"))
    library = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), path.alias("source_path"))
    return K.scope_aliases(library, manifest).select("doc_id", F.array_join("scope_aliases", ",").alias("scope_aliases"))


@query("""SELECT n_name AS slug, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS doc_ids FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 2 = 0 GROUP BY n_name""")
def expected_documents(spark, sf_dir):
    """Nations stand in for slugs, customers for the files of each."""
    n = read(spark, sf_dir, "nation")
    manifest = n.select(F.col("n_name").alias("slug"), F.concat(F.lit("m/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("filename"))
    library = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("/x/"), F.col("c_nationkey").cast("string"), F.lit(".md")).alias("source_path"))
    return K.expected_documents(manifest.select("slug"), manifest, library).select("slug", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("""SELECT event_id AS pos, doc_id, lang FROM (SELECT event_id, event_id * 7 % 1500 AS doc_id FROM events) JOIN documents USING (doc_id)""")
def recent_documents(spark, sf_dir):
    recent = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 7 % 1500).alias("doc_id"))
    return K.recent_documents(read(spark, sf_dir, "documents").select("doc_id", "lang"), recent)


@query("""SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)""")
def missing_documents(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    return K.missing_documents(p, read(spark, sf_dir, "documents"))


@query(f"WITH {_PASSAGES}, f AS (SELECT doc_id, arg_min(chunk_id, chunk_id) AS chunk_id, arg_min(text, chunk_id) AS text FROM p GROUP BY doc_id ORDER BY doc_id LIMIT 5) SELECT doc_id, chunk_id, md5(text) AS digest FROM f")
def library_overview(spark, sf_dir):
    """What is shown where a search finds nothing: the limit is the feature."""
    return K.overview(_library(spark, sf_dir).passages, 5).select("doc_id", "chunk_id", F.md5("text").alias("digest"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / greatest(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 1e-300), 6) AS squared FROM embeddings""")
def normalised_vectors(spark, sf_dir):
    v = K.normalised(read(spark, sf_dir, "embeddings"))
    return v.select("vec_id", F.round(R.inner_product(F.col("embedding"), F.col("embedding")), 6).alias("squared"))


@query(f"""SELECT * FROM (SELECT b.vec_id AS query_id, a.vec_id, {_INNER} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_INNER} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) WHERE rank <= 400 AND score > 0""")
def positive_neighbours(spark, sf_dir):
    """Neighbours of positive similarity only: fewer than asked for where others are negative."""
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return K.positive_top(q, e.select("vec_id", "embedding"), 400).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT conv_id, CAST(min(turn) AS BIGINT) AS created, max(turn) AS updated, count(*) AS turns FROM conversations WHERE conv_id % 10 <> 3 GROUP BY conv_id""")
def stored_snapshots(spark, sf_dir):
    """Snapshots written as text and read back, some deleted."""
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("name")).agg(F.min("turn").cast("long").alias("created"), F.max("turn").alias("updated"), F.count("*").alias("turns"))
    saved = c.select("name", "created", "updated", K.payload(F.struct("turns", F.lit("x").alias("unknown"))).alias("payload"))
    left = K.snapshots(K.without(saved, c.where("name % 10 = 3")))
    return left.select(F.col("name").alias("conv_id"), "created", "updated", K.restored(F.col("payload"), "turns long")["turns"].alias("turns"))


@query(r"""WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0) SELECT conv_id, 'paper' AS label, 1.0::DOUBLE AS confidence, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM t GROUP BY conv_id""")
def evidence_sets(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return K.evidence_set(c, "paper").select(F.col("query_id").alias("conv_id"), "label", "confidence", F.md5("evidence").alias("digest"))


_FLAGGED = """SELECT lang AS scope_source, CASE WHEN d.doc_id % 4 = 0 THEN quality = 1 ELSE d.doc_id % 3 = 0 END AS target_ok, CASE WHEN d.doc_id % 5 = 0 THEN toxic = 0 ELSE d.doc_id % 2 = 0 END AS overlap_ok FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


def _flagged(spark, sf_dir) -> DataFrame:
    """Labels stand in for report rows: some carry their own flags, others are judged by their ids."""
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    i = F.col("doc_id")
    rows = d.select(
        "doc_id", F.col("lang").alias("scope_source"), F.when(i % 4 == 0, F.col("quality") == 1).alias("inferred"), F.when(i % 5 == 0, F.col("toxic") == 0).alias("overlapping"),
        F.array(F.lit("a")).alias("expected"), F.array(F.when(i % 3 == 0, "a").otherwise("b")).alias("targets"), F.array(F.when(i % 2 == 0, "a").otherwise("c")).alias("final"), F.lit(None).cast("boolean").alias("passed"),
    )
    return K.row_flags(rows)


@query(f"""WITH r AS ({_FLAGGED}) SELECT coalesce(scope_source, 'all') AS scope_source, count(*) AS n, round(count(*) FILTER (target_ok) / count(*), 6) AS inferred_rate, round(count(*) FILTER (overlap_ok) / count(*), 6) AS overlap_rate FROM r GROUP BY ROLLUP (scope_source)""")
def probe_summary(spark, sf_dir):
    return K.probe_summary(_flagged(spark, sf_dir))


@query(f"""WITH r AS ({_FLAGGED}) SELECT target_ok, overlap_ok, NOT (target_ok AND overlap_ok) AS failed, count(*) AS n FROM r GROUP BY ALL""")
def report_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).groupBy("target_ok", "overlap_ok", "failed").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS run, round(sum(value) FILTER (event_id % 2 = 0), 6) AS cold, round(sum(value) FILTER (event_id % 2 = 1), 6) AS warm FROM events GROUP BY user_id""")
def latency_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_id") % 2 == 0, "cold").otherwise("warm").alias("cache_state"), F.col("value").alias("ms"))
    return K.latency_totals(e)


@query("""WITH r AS (SELECT source AS slug, doc_id AS run, quality = 0 AS dry, toxic = 1 AS lost FROM labels JOIN documents USING (doc_id)),
g AS (SELECT *, sum(CASE WHEN dry THEN 0 ELSE 1 END) OVER w AS a, sum(CASE WHEN lost THEN 0 ELSE 1 END) OVER w AS b FROM r WINDOW w AS (PARTITION BY slug ORDER BY run))
SELECT DISTINCT slug, 'no metrics' AS trigger FROM (SELECT slug FROM g WHERE dry GROUP BY slug, a HAVING count(*) >= 3) UNION ALL SELECT DISTINCT slug, 'off target' FROM (SELECT slug FROM g WHERE lost GROUP BY slug, b HAVING count(*) >= 2)""")
def monitoring_triggers(spark, sf_dir):
    """Labelled documents of a source stand in for its runs."""
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return K.monitoring(d.select(F.col("source").alias("slug"), F.col("doc_id").alias("run"), F.when(F.col("quality") == 0, 0).otherwise(1).alias("metric_count"), F.when(F.col("toxic") == 1, "off_target_evidence").otherwise("supported").alias("status")))


@query(f"""WITH {_BM25} {_TFIDF}, dn AS (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_INNER} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark))
SELECT query_id, 'bm25' AS method, doc_id, chunk_id, rank FROM bmr WHERE rank <= 5 UNION ALL SELECT query_id, 'tfidf', doc_id, chunk_id, rank FROM tfr WHERE rank <= 5 UNION ALL SELECT query_id, 'dense', doc_id, 0, rank FROM dn WHERE rank <= 5""")
def retrieval_comparison(spark, sf_dir):
    return K.comparison(asked(spark, sf_dir), _library(spark, sf_dir), _dense(spark, sf_dir, 5)[0], 5)


@query(f"""WITH {_POSTINGS}, own AS (SELECT post.* FROM post WHERE doc_id % 2 = 0), {_ASKED},
s AS (SELECT query_id, doc_id, chunk_id, round(sum(times * coalesce(idf, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT avg(length) FROM lens)))), 6) AS score FROM own JOIN lens USING (doc_id, chunk_id) JOIN q USING (term) LEFT JOIN idf USING (term) GROUP BY ALL HAVING score > 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def restricted_search(spark, sf_dir):
    """A search of some documents, with the statistics of all."""
    lib, some = _library(spark, sf_dir), read(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    return R.search(asked(spark, sf_dir), lib.restricted(some), "bm25", 5).select("query_id", "doc_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query()
def structured_counts(spark, sf_dir):
    return K.structured_counts(_synthesis(spark, sf_dir))


@query()
def metrics_report(spark, sf_dir):
    """The best passages of a query with the sentences that report metrics, else their summary."""
    lib = _library(spark, sf_dir)
    best = R.search(asked(spark, sf_dir), lib, "bm25", 4).join(lib.passages, ["doc_id", "chunk_id"])
    said = F.array_join(D.metric_sentences(F.col("text")), " ")
    return best.select("query_id", "rank", "doc_id", F.when(said != "", said).otherwise(X.summary(F.col("text"), F.lit(False))).alias("metrics"))
