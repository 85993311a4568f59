"""Queries of how a library is kept: the growing index, pages, reloading and repair, report graphs, rules, marks and abbreviations.

They are written over the same tables: conversations are documents whose turns are pages, orders are reports whose lines
are claims, and languages stand in for modes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import highlight as H
from lodestone.functions import text as X
from lodestone.operators import evaluation as E
from lodestone.operators import pages as P
from lodestone.operators import retrieval as R
from lodestone.plans.queries import _ASKED, _BM25, _PASSAGES, _POSTINGS, _STRIP, _TOKENS, _library, asked, query, read
from lodestone.sources import repair, reports, rules
from lodestone.sources import tables as S
from lodestone.sources.segments import SearchIndex

# ---------------------------------------------------------------- the growing index

#: What is left after the changes of ``_grown``.
_GROWN = """grown AS (SELECT doc_id, CASE WHEN lang = 'fr' AND length(text) < 500 THEN text || ' appended again' ELSE text END AS text FROM documents WHERE NOT (coalesce(lang, '') = 'de' AND length(text) >= 1000))"""


def _grown(spark, sf_dir) -> SearchIndex:
    """All documents in two additions, the short French ones again with other texts, the long German ones withdrawn."""
    docs = read(spark, sf_dir, "documents")
    index = SearchIndex(spark, f"{S.folder(spark)}/growing-{uuid.uuid4().hex}")
    english = F.coalesce(F.col("lang"), F.lit("")) == "en"
    index.add(docs.where(english))
    index.add(docs.where(~english))
    index.add(docs.where("lang = 'fr' and length(text) < 500").withColumn("text", F.concat("text", F.lit(" appended again"))))
    index.remove(docs.where("lang = 'de' and length(text) >= 1000").select("doc_id"))
    return index


@query(f"""WITH {_GROWN}, {_POSTINGS.replace("FROM documents", "FROM grown")}
SELECT term, df, round(idf, 6) AS idf, (SELECT count(DISTINCT doc_id) FROM lens) AS total_docs, (SELECT count(*) FROM lens) AS total_passages, (SELECT round(avg(length), 6) FROM lens) AS avg_length FROM df JOIN idf USING (term)""")
def growing_index(spark, sf_dir):
    """Frequencies and statistics that were adjusted by four changes."""
    lib = _grown(spark, sf_dir).library()
    return lib.df.join(lib.idf, "term").crossJoin(F.broadcast(lib.stats)).select("term", "df", F.round("idf", 6).alias("idf"), "total_docs", "total_passages", F.round("avg_length", 6).alias("avg_length"))  # stats is one row


@query(f"""WITH {_GROWN}, {_BM25.replace("FROM documents", "FROM grown")} SELECT query_id, doc_id, chunk_id, score, CAST(rank AS BIGINT) AS rank FROM bmr WHERE rank <= 10""")
def growing_search(spark, sf_dir):
    """A search of the changed index."""
    found = R.search(asked(spark, sf_dir), _grown(spark, sf_dir).library(), "bm25", 10)
    return found.select("query_id", "doc_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- pages

_PAGES = _PASSAGES.replace("FROM documents", "FROM (SELECT {'conv': conv_id, 'turn': turn} AS doc_id, text FROM conversations)")


@query(f"""WITH {_PAGES} SELECT doc_id.conv AS doc_id, doc_id.turn AS page, CAST(row_number() OVER (PARTITION BY doc_id.conv ORDER BY doc_id.turn, chunk_id) - 1 AS INT) AS chunk_id, md5(text) AS digest FROM p""")
def page_chunks(spark, sf_dir):
    """Conversations cut by turn, numbered on from turn to turn."""
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return P.page_passages(pages).select("doc_id", "page", "chunk_id", F.md5("text").alias("digest"))


@query()
def page_types(spark, sf_dir):
    """The same, annotated, each chunk with the type of its document."""
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return P.index_pages(pages).select("doc_id", "page", "chunk_id", "chunk_type", "doc_type", F.round("noise_level", 6).alias("noise_level"))


# ---------------------------------------------------------------- reload and repair


def _with_passages(docs):
    """The rows of ``docs`` with their counted passages; rows of one id, if there are any, share those of all of them."""
    again = R.repeated(docs.where("doc_id is not null"))
    if again is None:
        return R.counted_documents(docs)
    rows = docs.join(again, "doc_id", "left_semi")
    shared = R.counted_documents(rows).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    return R.counted_documents(docs.join(again, "doc_id", "left_anti")).unionByName(rows.drop("text").join(shared, "doc_id"))


def _stored_library(spark, sf_dir) -> repair.LibraryStore:
    """A record of every document, its passages without overlap; by the length of the text some are cut off, lack a field, have a field too many, or are stale."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = _with_passages(docs.withColumn("m", F.length("text") % 10)).withColumn("counts", F.transform("p", lambda p: F.map_from_entries(p["c"])))
    counts = F.col("counts")

    def plain(p):
        return F.struct(
            p["chunk_id"].alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("a/b.txt").alias("source_path"), F.lit(None).cast("int").alias("page"), p["text"].alias("text"), F.startswith(p["text"], F.lit("[TABLE/FIGURE]")).alias("is_table_or_figure"),
            F.lit(0.0).alias("noise_level"), F.when(F.col("m") == 3, "unknown").otherwise("body").alias("chunk_type"), F.lit("paper").alias("doc_type"),
        )

    record = F.struct(
        F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("m") != 1, F.lit("a/b.txt")).alias("source_path"), F.lit("txt").alias("ext"), F.lit("Title").alias("title"), F.when(F.col("m") == 5, "variant").otherwise("paper").alias("doc_type"),
        F.transform("p", plain).alias("passages"), F.when(F.col("m") != 4, F.transform(counts, lambda c: F.transform_values(c, lambda _, v: v.cast("double")))).alias("vectors"),
        F.when(F.col("m") != 2, counts).alias("term_counts"), F.when(F.col("m") != 2, F.transform("p", lambda p: p["n"])).alias("doc_lengths"),
    )
    line = F.to_json(record, {"ignoreNullFields": "false"})
    store = repair.LibraryStore(spark, f"{S.folder(spark)}/records-{uuid.uuid4().hex}")
    store.save(d.select(F.when(F.col("m") == 0, F.left(line, F.lit(40))).otherwise(line).alias("value")))
    return store


@query(rf"""WITH {_PASSAGES}, t AS (SELECT doc_id, len({_TOKENS("text")}) AS n FROM p), s AS (SELECT doc_id, count(*) AS passages, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY doc_id),
d AS (SELECT doc_id, length(coalesce(text, '')) % 10 AS m, coalesce(passages, 0) AS passages, coalesce(tokens, 0) AS tokens FROM documents LEFT JOIN s USING (doc_id))
SELECT CASE WHEN m > 1 THEN CAST(doc_id AS VARCHAR) END AS doc_id, CASE m WHEN 0 THEN 'not a document record' WHEN 1 THEN 'missing: source_path' END AS warning,
  CASE WHEN m > 1 THEN CASE WHEN m = 2 THEN 'term counts' WHEN m = 3 AND passages > 0 THEN 'chunk types' WHEN m = 4 THEN 'vectors' WHEN m = 5 THEN 'document type' ELSE '' END END AS repairs,
  CASE WHEN m > 1 THEN passages ELSE 0 END AS passages, CASE WHEN m > 1 THEN tokens ELSE 0 END AS tokens, CASE WHEN m > 1 THEN tokens ELSE 0 END AS counted, CASE WHEN m > 1 THEN tokens ELSE 0 END AS weight FROM d""")
def library_reload(spark, sf_dir):
    """What loading says of each line: sound, repaired in what, or a warning; and sums of the repaired fields (0 for a line with a warning)."""
    own = _stored_library(spark, sf_dir).load()
    total = lambda c: F.when(F.col("warning").isNull(), F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))
    of = lambda c: F.flatten(F.transform(c, lambda m: F.transform(F.map_values(m), lambda v: v.cast("long"))))
    return own.select("doc_id", "warning", F.array_join("repairs", ",").alias("repairs"), F.when(F.col("warning").isNull(), F.size("passages").cast("long")).otherwise(F.lit(0).cast("long")).alias("passages"), total(F.col("doc_lengths")).alias("tokens"), total(of(F.col("term_counts"))).alias("counted"), total(of(F.col("vectors"))).alias("weight"))


@query(r"""SELECT CASE WHEN m = 0 THEN 'not a document record' WHEN m = 1 THEN 'missing: source_path' ELSE 'sound' END AS state, count(*) AS n FROM (SELECT length(coalesce(text, '')) % 10 AS m FROM documents) GROUP BY 1""")
def library_repaired(spark, sf_dir):
    """The same after a repair: nothing is stale any more, and the lines with a warning are still there."""
    store = _stored_library(spark, sf_dir)
    store.repair()
    store.vacuum(1)
    return store.load().select(F.coalesce("warning", F.when(F.size("repairs") > 0, "stale"), F.lit("sound")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- reports as graphs


def _reports(spark, sf_dir):
    """Each order as a report: its lines are claims with a metric each; every tenth text is cut off, every eleventh has no title."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    cite = F.struct(s("l_partkey").alias("doc_id"), F.lit("p").alias("source_path"), F.col("l_suppkey").cast("int").alias("chunk_id"), F.lit(None).cast("int").alias("page"))
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_returnflag").alias("flag"), F.round("l_quantity").cast("int").cast("string").alias("qty"), cite.alias("cite"))
    own = li.select("l_orderkey", line.alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    own = o.join(own, o["o_orderkey"] == own["l_orderkey"])
    named = lambda p: lambda x: F.concat(F.lit(p), x["no"].cast("string"))
    claims = F.transform("x", lambda x: F.struct(named("c")(x).alias("id"), F.concat(F.lit("line "), x["qty"]).alias("statement"), F.when(x["flag"] == "R", "partially_supported").otherwise("supported").alias("support_status"), F.array(x["cite"]).alias("citations"), F.array(named("m")(x)).alias("related_metrics"), F.lit("more").alias("not_known")))
    metrics = F.transform("x", lambda x: F.struct(named("m")(x).alias("id"), F.lit("qty").alias("metric_label"), x["qty"].alias("value"), F.lit("d").alias("dataset"), x["cite"].alias("citation")))
    conflicts = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("x1").alias("id"), F.lit("values").alias("description"), F.lit("conflicting_evidence").alias("status"), F.transform("x", named("c")).alias("related_claim_ids"))))
    unsupported = F.when(F.col("o_orderstatus") == "O", F.array(F.struct(F.lit("u1").alias("id"), F.col("o_orderpriority").alias("topic"), F.lit("insufficient_evidence").alias("status"))))
    report = F.struct(
        F.when(F.col("o_orderkey") % 11 != 0, s("o_orderkey")).alias("title"), claims.alias("supported_claims"), metrics.alias("metric_summaries"), conflicts.alias("conflicts"), unsupported.alias("unsupported_claims"),
        F.struct(F.size("x").alias("total_passages"), F.lit(0).alias("figure_passages"), F.size("x").alias("metric_candidates")).alias("coverage"), F.struct(F.lit("supported").alias("render_status"), F.array(F.lit("c0")).alias("dropped_claim_ids")).alias("audit"),
    )
    text = F.to_json(report)
    return reports.read_reports(own.select(F.col("o_orderkey").alias("report"), F.when(F.col("o_orderkey") % 10 == 0, F.left(text, F.lit(60))).otherwise(text).alias("value")))


_SOUND = "so AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0), sl AS (SELECT * FROM so JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"""WITH {_SOUND}, e AS (
  SELECT o_orderkey AS report, 'holds' AS relation, 'report' AS source, 'c' || l_linenumber AS target FROM sl UNION ALL SELECT o_orderkey, 'holds', 'report', 'm' || l_linenumber FROM sl
  UNION ALL SELECT o_orderkey, 'cites', 'c' || l_linenumber, l_partkey || '#' || l_suppkey FROM sl UNION ALL SELECT o_orderkey, 'cites', 'm' || l_linenumber, l_partkey || '#' || l_suppkey FROM sl
  UNION ALL SELECT o_orderkey, 'uses', 'c' || l_linenumber, 'm' || l_linenumber FROM sl
  UNION ALL SELECT o_orderkey, 'about', 'x1', 'c' || l_linenumber FROM sl WHERE o_orderstatus = 'F'
  UNION ALL SELECT DISTINCT o_orderkey, 'holds', 'report', CASE o_orderstatus WHEN 'F' THEN 'x1' ELSE 'u1' END FROM sl WHERE o_orderstatus IN ('F', 'O')
  UNION ALL SELECT DISTINCT o_orderkey, 'dropped', 'report', 'c0' FROM sl)
SELECT report, relation, count(*) AS n, md5(string_agg(source || '>' || target, ',' ORDER BY source || '>' || target)) AS digest FROM e GROUP BY report, relation""")
def report_edges(spark, sf_dir):
    """The edges of each sound report by relation."""
    e = reports.edges(_reports(spark, sf_dir), "report").select("report", "relation", F.concat_ws(">", "source", "target").alias("x"))
    return e.groupBy("report", "relation").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("x")), ",")).alias("digest"))


@query(f"""WITH {_SOUND}, n AS (
  SELECT o_orderkey AS report, 'claim' AS kind, CASE l_returnflag WHEN 'R' THEN 'partially_supported' ELSE 'supported' END AS state FROM sl UNION ALL SELECT o_orderkey, 'metric', 'd' FROM sl
  UNION ALL SELECT DISTINCT o_orderkey, 'report', 'supported' FROM sl UNION ALL SELECT DISTINCT o_orderkey, 'conflict', 'conflicting_evidence' FROM sl WHERE o_orderstatus = 'F'
  UNION ALL SELECT DISTINCT o_orderkey, 'unsupported', 'insufficient_evidence' FROM sl WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'passage', NULL FROM (SELECT DISTINCT o_orderkey, l_partkey, l_suppkey FROM sl)
  UNION ALL SELECT DISTINCT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'not a report' ELSE 'missing: title' END, 'warning' FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 0 OR o_orderkey % 11 = 0)
SELECT kind, state, count(*) AS n, count(DISTINCT report) AS reports FROM n GROUP BY kind, state""")
def report_nodes(spark, sf_dir):
    """The nodes of all reports by kind and state, and the reports that couldn't be read."""
    r = _reports(spark, sf_dir)
    n = reports.nodes(r, "report").select("report", "kind", "state").union(r.where("warning is not null").select("report", "warning", F.lit("warning")))
    return n.groupBy("kind", "state").agg(F.count("*").alias("n"), F.count_distinct("report").alias("reports"))


# ---------------------------------------------------------------- rules

_ORDER_RULES = [rules.Rule("o_custkey", "unique"), rules.Rule("o_orderstatus", "one_of", ("F", "O")), rules.Rule("o_orderpriority", "one_of_or_todo", ("1-URGENT", "2-HIGH", "3-MEDIUM")), rules.Rule("note", "done"), rules.Rule("empty", "present"), rules.Rule("blank", "filled")]


@query(r"""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s, CASE WHEN o_orderkey % 5 = 0 THEN ' TODO: ask' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 7 = 0 THEN 'todo' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'n' END AS note,
  CASE WHEN o_orderkey % 3 > 0 THEN 'e' END AS empty, CASE WHEN o_orderkey % 4 > 0 THEN 'b' ELSE '  ' END AS blank FROM orders)
SELECT key, 'o_custkey' AS field, 'unique' AS rule, c AS value FROM o WHERE c IN (SELECT c FROM o GROUP BY c HAVING count(*) > 1)
UNION ALL SELECT key, 'o_orderstatus', 'one_of', s FROM o WHERE s NOT IN ('F', 'O') UNION ALL SELECT key, 'o_orderpriority', 'one_of_or_todo', p FROM o WHERE p NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND NOT starts_with(lower(trim(p)), 'todo')
UNION ALL SELECT key, 'note', 'done', note FROM o WHERE note IS NULL OR note = 'todo' UNION ALL SELECT key, 'empty', 'present', empty FROM o WHERE empty IS NULL UNION ALL SELECT key, 'blank', 'filled', blank FROM o WHERE trim(blank) = ''""")
def rule_violations(spark, sf_dir):
    """All rules of a table with planted faults in one pass."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(k % 5 == 0, " TODO: ask").otherwise(F.col("o_orderpriority"))).withColumn("note", F.when(k % 7 == 0, "todo").when(k % 7 != 1, "n"))
    return rules.violations(o.withColumn("empty", F.when(k % 3 > 0, "e")).withColumn("blank", F.when(k % 4 > 0, "b").otherwise("  ")), "o_orderkey", _ORDER_RULES)


# ---------------------------------------------------------------- marks and abbreviations


@query(rf"""WITH {_BM25}, bq AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9._+/-]*)', 1), lambda t: length(t) >= 3 OR regexp_matches(t, '^\d+$'))) AS terms, regexp_matches(lower(text), 'metric|auc|auroc|accuracy|precision|recall|f1|mcc|aupr|ap') AS asks FROM benchmark)
SELECT b.query_id, b.doc_id, b.chunk_id, CAST(coalesce(list_sum(list_transform(terms, lambda t: (length(p.text) - length(replace(lower(p.text), t, ''))) // length(t))), 0) + CASE WHEN asks THEN len(regexp_extract_all(p.text, '\d+(\.\d+)?%?')) ELSE 0 END AS BIGINT) AS spans
FROM bmr b JOIN p USING (doc_id, chunk_id) JOIN bq USING (query_id) WHERE rank <= 5""")
def marked_passages(spark, sf_dir):
    """How many spans are marked in the best passages of each query."""
    lib, q = _library(spark, sf_dir), asked(spark, sf_dir)
    best = R.search(q, lib, "bm25", 5).join(q, "query_id").join(lib.passages, ["doc_id", "chunk_id"])
    return best.select("query_id", "doc_id", "chunk_id", F.size(H.spans(F.col("text"), F.col("query"))).cast("long").alias("spans"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(lang, 'none') AS mode, left({_STRIP("text")}, 200) AS context, regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{M}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Z]{{2,4}})(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])', 1) AS w FROM documents),
e AS (SELECT doc_id, mode, context, lower(w[i]) AS token, i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)),
m AS (SELECT token, CAST(sum(n) AS BIGINT) AS frequency, max(n) AS most, string_agg(mode || ':' || n, ' ' ORDER BY mode) AS modes FROM (SELECT token, mode, count(*) AS n FROM e GROUP BY ALL) GROUP BY token HAVING sum(n) >= 2),
d AS (SELECT token, string_agg(doc_id || ':' || n, ' ' ORDER BY n DESC, doc_id) AS documents FROM (SELECT token, doc_id, count(*) AS n, row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, doc_id) AS r FROM e GROUP BY token, doc_id) WHERE r <= 10 GROUP BY token),
c AS (SELECT token, md5(string_agg(context, '|' ORDER BY r)) AS contexts FROM (SELECT token, context, row_number() OVER (PARTITION BY token ORDER BY doc_id, i) AS r FROM e) WHERE r <= 5 GROUP BY token)
SELECT token, frequency, modes, documents, contexts, round(least(1.0, 0.3 + 0.5 * most / frequency + 0.02 * least(frequency, 25)), 3) AS confidence, token NOT IN ('cm', 'arm', 'vus', 'afr', 'eur', 'pllr', 'auc', 'mcv') AND frequency >= 3 AS review FROM m JOIN d USING (token) JOIN c USING (token)""")
def abbreviation_details(spark, sf_dir):
    """The full report of short tokens: modes (languages here), ten documents, five contexts, and what to review."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_id"), F.coalesce("lang", F.lit("none")).alias("mode"), F.col("text").alias("context"), X.short_tokens(F.col("text")).alias("short_tokens"))
    own = E.abbreviation_details(docs)
    joined = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string"))), " ")
    return own.select("token", "frequency", joined(F.map_entries("modes"), "key", "value").alias("modes"), joined("documents", "doc_id", "n").alias("documents"), F.md5(F.array_join(F.transform("contexts", lambda c: c["context"]), "|")).alias("contexts"), "confidence", "review")
