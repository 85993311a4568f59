"""Evidence bundles, claims, conflicts, audit status, variant and assembly evidence, grounding of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V


def coverage(kept: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: passages, figure passages, metrics, documents, and the terms that no passage holds."""
    low = F.lower(F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    q = queries.select("query_id", X.query_terms(F.col("query")).alias("terms"))
    rows = kept.join(q, "query_id").withColumn("held", F.filter("terms", lambda t: F.instr(low, t) > 0))
    out = rows.groupBy("query_id").agg(
        F.count("*").alias("total_passages"), F.count_if(F.col("chunk_type").isin("caption", "figure_derived", "table")).alias("figure_passages"),
        F.sum("n_metrics").alias("metric_candidates"), F.array_sort(F.collect_set("doc_id")).alias("covered"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"),
    )
    missing = F.array_except(F.array_except("terms", F.coalesce("held", F.array().cast("array<string>"))), F.array(*map(F.lit, V.FRAMING_TERMS)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return q.join(out, "query_id", "left").select("query_id", zero("total_passages"), zero("figure_passages"), zero("metric_candidates"), F.array_join("covered", ",").alias("covered_doc_ids"), F.array_join(missing, ",").alias("missing_terms"))


def metric_conflicts(m: DataFrame) -> DataFrame:
    """(label, dataset, n_values, lowest, highest): one label and dataset with several values."""
    out = m.groupBy(F.lower("label").alias("label"), F.lower("dataset").alias("dataset")).agg(F.count_distinct("value").alias("n_values"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return out.where("n_values > 1")


def sentiment(c: Column, positive: list[str], negative: list[str]) -> Column:
    low = F.lower(c)
    return F.when(X.has_any(low, positive), 1).when(X.has_any(low, negative), -1).otherwise(0)


def narrative_conflicts(claims: DataFrame) -> DataFrame:
    """(query_id, a, b): claims of one query (few each) of opposite sentiment that share a token; they meet on it."""
    tokens = claims.where("sentiment <> 0").select("query_id", "pos", "sentiment", F.explode("tokens").alias("token"))
    a, b = tokens.alias("a"), tokens.alias("b")
    on = [F.col("a.query_id") == F.col("b.query_id"), F.col("a.token") == F.col("b.token"), F.col("a.pos") < F.col("b.pos"), F.col("a.sentiment") * F.col("b.sentiment") < 0]
    return a.join(b, on).select(F.col("a.query_id").alias("query_id"), F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).distinct()


def audit(claims: Column, unsupported: Column, has_targets: Column, covered: Column, on_target: Column, intent: Column, metrics: Column, conflicts: Column, topic: Column) -> Column:
    """The status of an answer: the last rule of the chain that holds, so the order below is that of precedence."""
    base = F.when(claims > 0, "supported").otherwise("insufficient_evidence")
    held = base == "supported"
    soft = F.when(held & (unsupported >= claims), "partially_supported").when(held & (conflicts > 0), "conflicting_evidence").otherwise(base)
    missed = has_targets & ~covered
    return (
        F.when(intent & (metrics == 0), "insufficient_evidence")
        .when((claims > 0) & has_targets & ~on_target & covered, "off_target_evidence")
        .when(missed & topic & ~intent, "insufficient_evidence")
        .when(missed, "off_target_evidence")
        .otherwise(soft)
    )


def verify(claims: DataFrame) -> DataFrame:
    """Claims without a citation become unsupported."""
    return claims.withColumn("supported", F.coalesce(F.size("citations"), F.lit(0)) > 0)


def repeated_labels(spans: DataFrame) -> DataFrame:
    """Every repeat of a label after its first in the set."""
    w = Window.partitionBy("set_id", "label").orderBy("pos")
    return spans.withColumn("n", F.row_number().over(w)).where("n > 1").drop("n")


def variant_fields(p: DataFrame) -> DataFrame:
    """Variant, gene, phenotype, cohort, ancestry, counts, class and frequency of each passage; Unknown where none."""
    c, low = F.col("text"), F.lower("text")
    first = lambda *ps: F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in ps))
    named = lambda pairs: F.coalesce(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in pairs), F.lit("Unknown"))
    number = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).cast("int")
    ident = first(*V.VARIANT_IDS)
    protein = first(*V.PROTEINS)
    gene = F.coalesce(first(*V.GENES_BEFORE), F.upper(first(V.GENE_NAMED)), F.lit("Unknown"))
    phenotype = F.coalesce(*(F.when(X.has_any(low, ws), F.lit(k)) for k, ws in V.PHENOTYPES.items()), F.lit("Unknown"))
    ancestry = sorted(V.ANCESTRIES.items(), key=lambda kv: -len(kv[0]))
    clinvar = F.when(X.has_any(low, ["clinvar", "classification"]), named(V.CLINVAR.items())).otherwise("Unknown")
    return p.select(
        "*", X.canonical_hgvs(ident).alias("variant_id"), X.canonical_hgvs(protein).alias("hgvs"), gene.alias("gene"), phenotype.alias("phenotype"), named(V.COHORTS.items()).alias("cohort"),
        named(ancestry).alias("ancestry"), number(V.CASES).alias("case_count"), number(V.CONTROLS).alias("control_count"),
        clinvar.alias("clinvar"), F.coalesce(F.nullif(F.regexp_extract(low, V.GNOMAD, 1), F.lit("")), F.lit("Unknown")).alias("gnomad"),
    )


def variant_confidence(v: DataFrame) -> Column:
    has = lambda *cs: X._any([F.col(c) != "Unknown" for c in cs])
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    raw = 0.35 + plus(has("variant_id", "hgvs"), 0.25) + plus(has("gene"), 0.15) + plus(has("clinvar"), 0.1) + plus(F.col("n_metrics") > 0, 0.1) + plus(has("ancestry"), 0.05) + plus(F.col("doc_type") == "variant", 0.05)
    return F.greatest(F.lit(0.2), F.least(F.lit(0.95), raw))


def variant_conflicts(v: DataFrame) -> DataFrame:
    """(variant, labels): one variant with several classes."""
    own = v.where("variant_id <> 'Unknown' and clinvar <> 'Unknown'").groupBy(F.lower("variant_id").alias("variant")).agg(F.array_sort(F.collect_set("clinvar")).alias("l"))
    return own.where(F.size("l") > 1).select("variant", F.array_join("l", ", ").alias("labels"))


def assembly_lines(p: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, name, value): lines under 120 characters split at their first colon."""
    rows = p.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.contains("line", F.lit(":")) & (F.length("line") < 120))
    at = F.instr("line", F.lit(":"))
    return rows.select(key, "pos", X.strip(F.substr("line", F.lit(1), at - 1)).alias("name"), X.strip(F.substr("line", at + 1)).alias("value"))


def groundedness(answer: Column, evidence: Column) -> tuple[Column, Column]:
    """(coverage, score): the share of the answer's words that the evidence has; 5 from 0.6, 3 from 0.3, else 1."""
    words = X.evidence_words(answer)
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, X.evidence_words(evidence))) / F.size(words)).otherwise(0.0)
    return share, F.when(share >= 0.6, 5).when(share >= 0.3, 3).otherwise(1)


def citations(answer: Column) -> Column:
    """(doc, chunk) pairs cited in an answer."""
    cited = F.regexp_extract_all(answer, F.lit(r"(\[CITE doc=\S+ \S+ chunk=\d+)"), F.lit(1))
    return F.transform(cited, lambda s: F.struct(F.regexp_extract(s, r"doc=(\S+)", 1).alias("doc"), F.regexp_extract(s, r"chunk=(\d+)", 1).cast("int").alias("chunk")))


def citation_guard(answer: Column, searched: Column, has_evidence: Column, allowed: Column) -> Column:
    """Why an answer isn't safe, or ok."""
    cited = citations(answer)
    unknown = F.exists(cited, lambda c: ~F.array_contains(allowed, F.concat_ws(":", c["doc"], c["chunk"].cast("string"))))
    return (
        F.when(has_evidence & (F.size(cited) == 0), "no citations")
        .when(~searched & (F.size(cited) > 0), "citations without search")
        .when(unknown, "unknown citation")
        .when(X._any([answer.rlike("(?i)" + p) for p in V.SUSPICIOUS]), "possible hallucination")
        .when(has_evidence & F.exists(X.sentences(answer), lambda s: s.rlike("(?i)" + V.NEEDS_CITATION) & ~F.contains(s, F.lit("[CITE"))), "number without citation")
        .otherwise("ok")
    )
