"""Pages by mode: paper, variant and assembly questions have pages of their own, made in one plan and united."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import evidence as S
from lodestone.operators import synthesis as Y

_WORDS = "array<string>"


def _some(c: str) -> Column:
    return F.col(c) != "Unknown"


def variant_candidates(kept: DataFrame, asked: DataFrame) -> DataFrame:
    """The kept passages that say something of a variant, with fields, confidence and its reasons.

    ``kept``: query_id, rank, doc_id, chunk_id, text, summary, short_tokens, chunk_type, doc_type, records, n_metrics;
    ``asked``: query_id, variant_id, phenotype (null where a question names none).
    """
    hints = asked.select("query_id", F.nullif("variant_id", F.lit("")).alias("asked_variant"), F.nullif(X.strip(F.col("phenotype")), F.lit("")).alias("asked_phenotype"))
    c = kept.join(hints, "query_id").withColumn("own", F.coalesce(F.nullif("text", F.lit("")), "summary", F.lit("")))
    c = c.withColumn("text", X.strip(F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))))
    v = S.variant_fields(c).withColumn("text", F.col("own")).drop("own")
    v = v.withColumn("hgvs", F.when(_some("variant_id"), F.col("variant_id")).otherwise(F.col("hgvs")))
    v = v.withColumn("variant_id", F.coalesce("asked_variant", "hgvs")).withColumn("phenotype", F.coalesce("asked_phenotype", "phenotype"))
    short = F.coalesce("short_tokens", F.array().cast(_WORDS))
    own_cohort = F.coalesce(*(F.when(F.array_contains(short, t), V.COHORTS[t]) for t in ("cm", "arm")), F.lit("Unknown"))
    v = v.withColumn("cohort", F.when(_some("cohort"), F.col("cohort")).otherwise(own_cohort))
    told = X._any([_some(n) for n in ("variant_id", "hgvs", "gene", "clinvar", "phenotype")]) | (F.col("n_metrics") > 0)
    why = F.array_compact(F.array(
        F.when(_some("variant_id") | _some("hgvs"), "variant id"), F.when(_some("gene"), "gene mention"), F.when(_some("clinvar"), "clinvar classification"),
        F.when(F.col("n_metrics") > 0, "metrics"), F.when(_some("ancestry"), "ancestry"), F.when(F.col("doc_type") == "variant", "variant doc"),
    ))
    reason = F.when(F.size(why) > 0, F.array_join(why, ", ")).otherwise("baseline")
    return v.where(told).withColumn("confidence", F.round(S.variant_confidence(v), 2)).withColumn("reason", reason)


def variant_conflicts(v: DataFrame) -> DataFrame:
    """(query_id, contradictions): variants, else genes of a document, that a question's passages put in several classes."""
    place = F.concat_ws(" chunk ", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string"))
    own = F.when(_some("variant_id"), F.lower("variant_id")).otherwise(F.concat_ws("\x01", place, F.lower("gene")))
    label = F.when(_some("variant_id"), F.col("variant_id")).when(_some("gene"), F.concat("gene", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")"))).otherwise(place)
    rows = v.where(_some("clinvar")).withColumn("key", own).groupBy("query_id", "key").agg(F.min_by(label, F.col("rank")).alias("label"), F.min("rank").alias("at"), F.array_sort(F.collect_set("clinvar")).alias("classes"))
    line = F.concat(F.lit(V.MODE_NOTES["conflict"]), "label", F.lit(": "), F.array_join("classes", ", "))
    rows = rows.where(F.size("classes") > 1).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("x"))
    return rows.select("query_id", F.transform("x", lambda x: x["line"]).alias("contradictions"))


def variant_bundle(kept: DataFrame, asked: DataFrame) -> DataFrame:
    """One row a question: counts, missing fields, terms that no passage holds, notes, contradictions and candidates in their order (few a question).

    ``asked``: query_id, query, variant_id, phenotype.
    """
    v = variant_candidates(kept, asked)
    low = F.lower(F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    q = asked.select("query_id", "query", "variant_id", "phenotype", X.query_terms(F.col("query")).alias("terms"))
    seen = kept.join(q.select("query_id", "terms"), "query_id").groupBy("query_id").agg(F.count("*").alias("total_passages"), F.array_distinct(F.flatten(F.collect_set(F.filter("terms", lambda t: F.instr(low, t) > 0)))).alias("held"))
    known = lambda *cs: F.count_if(X._any([_some(c) for c in cs]))
    wanted = F.lower("asked_variant").isin(F.lower("variant_id"), F.lower("hgvs"))
    standing = F.filter(F.coalesce("short_tokens", F.array().cast(_WORDS)), lambda t: F.array_contains(F.array(*map(F.lit, V.SHORT_TOKENS)), t))
    item = F.struct("rank", "doc_id", "chunk_id", "variant_id", "gene", "clinvar", "phenotype", "cohort", "ancestry", "case_count", "control_count", "gnomad", "confidence", "reason", "chunk_type", "doc_type", F.slice("records", 1, 3).alias("records"), X.excerpt(X.strip(F.col("text"))).alias("excerpt"))
    per = v.groupBy("query_id").agg(
        F.count("*").alias("candidates"), known("variant_id", "hgvs").alias("variants"), F.coalesce(F.bool_or(wanted), F.lit(False)).alias("requested"), known("ancestry").alias("ancestries"), known("phenotype").alias("phenotypes"),
        known("clinvar").alias("classes"), F.count("case_count").alias("cases"), F.count("control_count").alias("controls"), known("gnomad").alias("frequencies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~_some("ancestry"), standing))))).alias("hints"), F.array_sort(F.collect_list(item)).alias("items"),
    )
    row = q.join(seen, "query_id", "left").join(per, "query_id", "left").join(variant_conflicts(v), "query_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    gone = {
        "variant": none("variants"), "requested variant": (F.coalesce("variant_id", F.lit("")) != "") & ~F.coalesce("requested", F.lit(False)), "requested phenotype": (F.coalesce("phenotype", F.lit("")) != "") & none("phenotypes"),
        "ancestry": none("ancestries"), "class": none("classes"), "cases": none("cases"), "controls": none("controls"), "frequency": none("frequencies"),
    }
    missing = F.array_compact(F.array(*(F.when(cond, F.lit(V.VARIANT_FIELDS[n])) for n, cond in gone.items())))
    uncovered = F.array_except("terms", F.coalesce("held", F.array().cast(_WORDS)))
    hints = F.coalesce("hints", F.array().cast(_WORDS))
    notes = F.array_compact(F.array(
        F.when(F.size(uncovered) > 0, F.concat(F.lit(V.MODE_NOTES["terms"]), F.array_join(uncovered, ", "))),
        F.when(none("ancestries") & (F.size(hints) > 0), F.concat(F.lit(V.MODE_NOTES["hints"]), F.array_join(hints, ", "))),
    ))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return row.select("query_id", "query", "variant_id", "phenotype", count("total_passages"), count("candidates"), count("ancestries"), count("phenotypes"), missing.alias("missing"), uncovered.alias("uncovered"), notes.alias("notes"), F.coalesce("contradictions", F.array().cast(_WORDS)).alias("contradictions"), F.coalesce("items", F.array().cast(per.schema["items"].dataType)).alias("items"))


def variant_page(b: DataFrame) -> DataFrame:
    """(query_id, page) of variant bundles."""
    listed = lambda c: F.array_join(c, ", ")
    text = lambda x, n: F.when(x[n] != "Unknown", x[n])
    counted = lambda x, n, name: F.when(x[n].isNotNull(), F.concat(F.lit(f"{name}="), x[n].cast("string")))

    def lines(x: Column) -> Column:
        head = F.concat(F.lit("- "), F.when(x["variant_id"] != "Unknown", F.concat(x["variant_id"], F.lit(" ("), x["gene"], F.lit(")"))).otherwise(F.concat(F.lit("Gene context: "), x["gene"])), F.lit(" · "), x["clinvar"])
        source = F.concat(F.lit("  Source: "), x["doc_id"].cast("string"), F.lit(" · chunk "), x["chunk_id"].cast("string"), F.lit(" ["), x["chunk_type"], F.lit("/"), x["doc_type"], F.lit("] · conf="), F.format_number(x["confidence"], 2), F.lit(" ("), x["reason"], F.lit(")"))
        context = F.array_compact(F.array(text(x, "cohort"), text(x, "ancestry"), counted(x, "case_count", "cases"), counted(x, "control_count", "controls"), F.when(x["gnomad"] != "Unknown", F.concat(F.lit("gnomAD="), x["gnomad"]))))
        metrics = F.transform(x["records"], lambda r: F.concat(F.lit("  Metric: "), r["label"], F.lit("="), r["value"]))
        single = F.array(head, source, F.concat(F.lit("  Phenotype: "), text(x, "phenotype")), F.when(F.size(context) > 0, F.concat(F.lit("  Context: "), F.array_join(context, "; "))))
        return F.array_join(F.concat(F.array_compact(single), metrics, F.array(F.concat(F.lit("  Excerpt: "), x["excerpt"]))), "\n")

    body = F.when(F.size("items") > 0, F.concat(F.lit("## Evidence\n"), F.array_join(F.transform("items", lines), "\n"))).otherwise(V.MODE_NOTES["no variants"])
    reviewed = F.concat(F.lit("\n\n## Coverage\n- Passages reviewed: "), F.col("total_passages").cast("string"), F.lit(" | Variant-grounded: "), F.col("candidates").cast("string"))
    more = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n- {name}: "), listed(c))).otherwise("")
    notes = F.array_join(F.transform("notes", lambda n: F.concat(F.lit("\n- Note: "), n)), "")
    against = F.when(F.size("contradictions") > 0, F.concat(F.lit("\n\n## Contradictions\n- "), F.array_join("contradictions", "\n- "))).otherwise("")
    head = F.concat(F.lit("# Variant evidence for "), F.coalesce("variant_id", F.lit("Unknown variant")), F.coalesce(F.concat(F.lit("\nPhenotype hint: "), "phenotype"), F.lit("")), F.lit("\n"))
    return b.select("query_id", F.concat(head, body, reviewed, more("Missing fields", F.col("missing")), more("Uncovered query terms", F.col("uncovered")), notes, against).alias("page"))


def assembly_page(kept: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, page): the measures of an assembly that the kept passages list, or a warning. ``asked``: query_id, sample_id."""
    lines = S.assembly_lines(kept.select(F.struct("query_id", "rank").alias("k"), "text"), "k")
    item = F.struct(F.col("k.rank").alias("rank"), "pos", F.concat(F.lit("- "), "name", F.lit(": "), "value").alias("line"))
    own = lines.groupBy(F.col("k.query_id").alias("query_id")).agg(F.array_sort(F.collect_list(item)).alias("x"))  # lines of a question's few passages
    body = F.coalesce(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("Warnings:\n  * " + V.MODE_NOTES["no metrics"]))
    return asked.join(own, "query_id", "left").select("query_id", F.concat(F.lit("Assembly QC report for "), F.coalesce("sample_id", F.lit("sample")), F.lit("\n"), body).alias("page"))


def pages(questions: DataFrame, kept: DataFrame, records: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, mode, page) of all questions that keep a passage; a mode that is not known counts as paper.

    ``questions``: query_id, query, mode, variant_id, phenotype, sample_id. ``kept`` and ``records`` as the modes' operators take them.
    """
    known = F.lower(F.coalesce("mode", F.lit("paper")))
    q = questions.withColumn("mode", F.when(known.isin("variant", "assembly"), known).otherwise("paper")).join(kept.select("query_id").distinct(), "query_id", "left_semi")
    of = lambda df, m: df.join(q.where(F.col("mode") == m).select("query_id"), "query_id", "left_semi")
    own = lambda m: q.where(F.col("mode") == m)
    paper = Y.page(Y.verify(Y.build(own("paper").select("query_id", "query"), of(kept, "paper"), of(records, "paper"), of(targets, "paper"))))
    variant = variant_page(variant_bundle(of(kept, "variant"), own("variant")))
    assembly = assembly_page(of(kept, "assembly"), own("assembly"))
    whole = paper.select("query_id", "page").unionByName(variant).unionByName(assembly)
    return q.select("query_id", "mode").join(whole, "query_id").select("query_id", "mode", "page")
