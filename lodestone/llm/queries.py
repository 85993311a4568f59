"""The thin queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann_forest, decontam, eflm, fst_tokens, html_extract, interval_join, jaccard_join, langid, minmax_dedup, packing, ranked_search, toxicity, url_templates

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eflm.score(table(spark, sf_dir, "documents"))


def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_tokens.count_tokens(table(spark, sf_dir, "documents"), fst_tokens.resolve(TOKENIZER))


def op5_prefix_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_prefix_tree_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the number of links of each row; the SQL of the query above has no such column."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=3, percent=90, links=True)


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), fst_tokens.resolve(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_prefix_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(table(spark, sf_dir, "embeddings"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_path_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op9_dom_content_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_positional_decontamination_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of whole items that the exact windows miss or hit: one row per document and item."""
    return decontam.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2).drop("row")


def op11_bisected_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_interval_tree_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_join.join(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clicks"))


def op13_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.dedup(table(spark, sf_dir, "documents"), k=5, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_elias_fano_lm,
        op2_byte_cnn_language,
        op3_ngram_toxicity,
        op4_fst_token_counts,
        op5_prefix_tree_jaccard,
        op5_prefix_tree_jaccard_links,
        op6_cost_balanced_packing,
        op7_prefix_forest_search,
        op8_path_template_filter,
        op9_dom_content_model,
        op10_positional_decontamination,
        op10_positional_decontamination_near,
        op11_bisected_ranked_search,
        op12_interval_tree_sessions,
        op13_minmax_near_dedup,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WHITE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _near_sql(k: int, percent: int, kept: str = "") -> str:
    """Components of links between whole shingle sets."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WHITE_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, t FROM (
        SELECT doc_id, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id{kept}
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op5_prefix_tree_jaccard": _near_sql(3, 90),
    "op13_minmax_near_dedup": _near_sql(5, 85, ", d.doc_id = c.component_id AS kept"),
    "op10_positional_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM grams JOIN win USING (k, t)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words_hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(words_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_bisected_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
k AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, g GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, g),
i AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY q, item_id, t),
x AS (SELECT q, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM i JOIN k USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20""",
    "op12_interval_tree_sessions": """
WITH byte AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS error FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= 900000000 THEN 0 ELSE 1 END AS begins FROM k),
n AS (SELECT *, sum(begins) OVER (PARTITION BY client_id ORDER BY us, begins DESC ROWS UNBOUNDED PRECEDING) AS no FROM b),
f AS (SELECT client_id, min(us) AS first, max(us) AS last, max({'us': us, 'error': error}).error AS open FROM n GROUP BY client_id, no),
ses AS (SELECT client_id, first, first // 21600000000 - CAST(first % 21600000000 < 0 AS BIGINT) AS s,
               CASE WHEN open THEN NULL ELSE last // 21600000000 - CAST(last % 21600000000 < 0 AS BIGINT) END AS e FROM f),
c AS (SELECT client_id, s, e, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(first AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM ses, byte),
ship AS (SELECT sale_id, max(epoch_us(shipped_at)) AS us FROM sale_lines GROUP BY sale_id),
own AS (SELECT row_number() OVER () AS r, sale_id, client_id, status = 'open' AS open, epoch_us(sold_at) AS first FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
sale AS (SELECT r, own.sale_id, client_id, first // 21600000000 - CAST(first % 21600000000 < 0 AS BIGINT) AS s,
                CASE WHEN open THEN NULL ELSE greatest(first, coalesce(us, first)) // 21600000000 - CAST(greatest(first, coalesce(us, first)) % 21600000000 < 0 AS BIGINT) END AS e
         FROM own LEFT JOIN ship ON own.sale_id = ship.sale_id),
p AS (SELECT r, sale_id, a.s AS s, c.s AS s2, coalesce(a.e, 4611686018427387904) AS e, coalesce(c.e, 4611686018427387904) AS e2, crc
      FROM sale a JOIN c ON a.client_id = c.client_id AND a.s <= coalesce(c.e, 4611686018427387904) AND c.s <= coalesce(a.e, 4611686018427387904))
SELECT sale_id, CASE WHEN s < s2 THEN CASE WHEN e < e2 THEN 'overlaps' WHEN e = e2 THEN 'finished_by' ELSE 'contains' END
                     WHEN s = s2 THEN CASE WHEN e < e2 THEN 'starts' WHEN e = e2 THEN 'equals' ELSE 'started_by' END
                     ELSE CASE WHEN e < e2 THEN 'during' WHEN e = e2 THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
       count(*) AS n_pairs, CAST(sum(CASE WHEN e = 4611686018427387904 AND e2 = e THEN NULL ELSE least(e, e2) - greatest(s, s2) + 1 END) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc
FROM p GROUP BY r, sale_id, 2""",
}
