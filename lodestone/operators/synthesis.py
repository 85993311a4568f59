"""Structured synthesis: claims, what they leave out, limitations, conflicts and the audit status, one row a query; verification and the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import evaluation as E
from lodestone.operators import evidence as S

CLAIM = "array<struct<pos:int,statement:string,strength:string,quality:string,doc_id:string,chunk_id:int,label:string,value:string,model:string,dataset:string>>"
NOTE = "array<struct<topic:string,reason:string,action:string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """(query_id, name): the rows of a query in their order, as one list (few a query)."""
    item = F.struct(*(F.col(c) for c in ("pos", "statement", "strength", "quality", "doc_id", "chunk_id", "label", "value", "model", "dataset")))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).cast(CLAIM).alias(name))


def intents(query: Column) -> tuple[Column, Column]:
    """(asks for metrics, asks what are the ... of a paper)."""
    words = F.regexp_extract_all(query, F.lit("([A-Za-z0-9._+-]+)"), F.lit(1))
    low = F.lower(F.array_join(F.filter(F.split(query, r"\s+"), lambda w: w != ""), " "))
    return F.coalesce(X.metric_intent(words, V.METRIC_EVIDENCE_TERMS), F.lit(False)), F.coalesce(F.contains(low, F.lit("what are")) & F.contains(low, F.lit("paper")), F.lit(False))


def _opposed(claims: Column) -> Column:
    """Pairs of claims of opposite sentiment that share a word of weight."""
    words = lambda c: F.array_except(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c["statement"]), r"[^\p{L}\p{N}]", " "), " +"), lambda w: F.length(w) >= 5)), F.array(*map(F.lit, V.CLAIM_STOPWORDS)))
    mood = lambda c: F.when(X.has_any(F.lower(c["statement"]), V.POSITIVE_WORDS), 1).otherwise(0) - F.when(X.has_any(F.lower(c["statement"]), V.NEGATIVE_WORDS), 1).otherwise(0)
    shared = lambda a, b: F.array_sort(F.array_intersect(words(a), words(b)))
    text = lambda a, b: F.concat(F.lit("Narrative disagreement on "), F.left(F.array_join(shared(a, b), "/"), F.lit(40)), F.lit(": '"), F.left(a["statement"], F.lit(90)), F.lit("' vs '"), F.left(b["statement"], F.lit(90)), F.lit("'"))
    pairs = F.flatten(F.transform(claims, lambda a: F.transform(claims, lambda b: F.when((a["pos"] < b["pos"]) & (mood(a) * mood(b) < 0) & (F.size(shared(a, b)) > 0), text(a, b)))))
    return F.array_compact(pairs)


def _differing(metrics: Column) -> Column:
    """One line for each label and dataset that the metrics give several values."""
    key = lambda m: F.concat_ws("\x01", F.lower(m["label"]), F.lower(m["dataset"]))
    group = lambda k: F.filter(metrics, lambda m: key(m) == k)
    line = lambda g: F.concat(F.lit("Conflicting "), g[0]["label"], F.lit(" values on "), g[0]["dataset"], F.lit(": "), F.array_join(F.transform(g, lambda m: F.concat(m["value"], F.lit(" ("), m["model"], F.lit(")"))), ", "))
    return F.array_compact(F.transform(F.array_distinct(F.transform(metrics, key)), lambda k: F.when(F.size(F.array_distinct(F.transform(group(k), lambda m: m["value"]))) > 1, line(group(k)))))


def build(queries: DataFrame, kept: DataFrame, metrics: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """One row a query: claims, metrics, unsupported, limitations, conflicts, status, counts.

    ``kept``: query_id, rank, doc_id, chunk_id, text, summary, chunk_type, n_metrics; ``metrics``: query_id, pos, label, value,
    model, dataset, doc_id, chunk_id; ``targets``: query_id, doc_id. Metrics become claims first; passages only where a
    query asks for none and there are none. Claims of target documents come first.
    """
    named = targets.groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("targets"))
    cover = S.coverage(kept, queries).join(queries, "query_id").join(named, "query_id", "left").withColumn("targets", F.coalesce("targets", _none("array<string>")))
    intent, topic = intents(F.col("query"))
    covered = F.arrays_overlap("targets", F.split("covered_doc_ids", ","))
    cover = cover.select("query_id", "query", "targets", "total_passages", "metric_candidates", F.filter(F.split("missing_terms", ","), lambda t: t != "").alias("missing"), intent.alias("intent"), topic.alias("topic"), covered.alias("covered"))
    withheld = (F.size("targets") > 0) & ~F.col("intent") & F.col("topic") & (F.col("total_passages") > 0) & ~F.col("covered")
    cover = cover.withColumn("withheld", withheld)
    facts = cover.select("query_id", "targets", "intent", "withheld")
    last = lambda own: F.when(own, F.when(F.array_contains("targets", F.col("doc_id").cast("string")), 0).otherwise(1)).otherwise(0)
    text = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    own = metrics.join(facts, "query_id").where("not withheld").withColumn("late", last(F.col("intent")))
    own = E.recent(own.drop("rank"), "query_id", [F.col("late"), F.col("pos")], most).withColumn("pos", F.col("rank"))
    said = F.concat(F.coalesce(F.nullif("model", F.lit("")), F.lit("Model")), F.lit(" reported "), "label", F.lit("="), "value", F.lit(" on "), F.coalesce(F.nullif("dataset", F.lit("")), F.lit("dataset")))
    own = own.select("query_id", "pos", said.alias("statement"), F.lit("direct_metric").alias("strength"), F.lit("high").alias("quality"), F.col("doc_id").cast("string").alias("doc_id"), "chunk_id", "label", "value", "model", "dataset")
    plain = kept.join(facts, "query_id").where("not withheld and not intent").withColumn("late", last(F.lit(True))).withColumn("pos", F.col("rank"))
    plain = E.recent(plain.drop("rank"), "query_id", [F.col("late"), F.col("pos")], most).withColumn("statement", F.left(X.strip(F.coalesce(F.nullif("summary", F.lit("")), "text", F.lit(""))), F.lit(280))).where("statement <> ''")
    plain = plain.select("query_id", F.col("rank").alias("pos"), "statement", F.lit("passage_summary").alias("strength"), F.lit("medium").alias("quality"), F.col("doc_id").cast("string").alias("doc_id"), "chunk_id", *text("label", "value", "model", "dataset"))
    row = cover.join(_listed(own, "metrics"), "query_id", "left").join(_listed(plain, "plain"), "query_id", "left")
    row = row.withColumn("metrics", F.coalesce("metrics", _none(CLAIM))).withColumn("claims", F.when(F.size("metrics") > 0, F.col("metrics")).otherwise(F.coalesce("plain", _none(CLAIM)))).drop("plain")
    note = lambda topic_, why, do: F.struct(topic_.alias("topic"), why.alias("reason"), do.alias("action"))
    short = F.col("intent") & (F.size("metrics") == 0)
    left_out = F.transform("missing", lambda t: note(F.concat(F.lit("Query coverage for '"), t, F.lit("'")), F.lit(V.NOTES["term"]), F.concat(F.lit("Search additional documents for '"), t, F.lit("'."))))
    asked = F.when(short, F.array(note(F.lit(V.NOTES["metrics topic"]), F.lit(V.NOTES["metrics"]), F.lit(V.NOTES["metrics action"])))).otherwise(_none(NOTE))
    row = row.withColumn("unsupported", F.concat(left_out, asked).cast(NOTE)).withColumn("conflicts", F.concat(_differing(F.col("metrics")), _opposed(F.col("claims"))))
    scoped = (F.size("targets") > 0) & (F.col("total_passages") > 0)
    on_target = F.exists("claims", lambda c: F.array_contains(F.col("targets"), c["doc_id"]))
    row = row.withColumn("on_target", on_target).withColumn("scoped", scoped)
    limits = F.array_compact(F.array(
        F.when(F.col("scoped") & F.col("withheld"), F.lit(V.NOTES["withheld"])).when(F.col("scoped") & ~F.col("covered"), F.concat(F.lit(V.NOTES["missing targets"]), F.array_join("targets", ", "))),
        F.when((F.size("targets") > 0) & (F.size("claims") > 0) & ~F.col("on_target"), F.lit(V.NOTES["off target"])),
        F.when(short, F.lit(V.NOTES["no metrics"])),
    ))
    # Claims of non-targets alone are off target whether or not a target was covered.
    status = S.audit(F.size("claims"), F.when(F.size("unsupported") > 0, F.size("unsupported")).otherwise(-1), F.col("scoped"), F.col("covered"), F.col("on_target"), F.col("intent"), F.size("metrics"), F.size("conflicts"), F.col("withheld"))
    return row.withColumn("limitations", limits).withColumn("status", status).drop("missing", "topic", "withheld", "on_target", "scoped", "covered")


def verify(s: DataFrame) -> DataFrame:
    """Claims without a citation become unsupported, and the status falls where too little is left."""
    cited = lambda c: c["doc_id"].isNotNull()
    lost = F.transform(F.filter("claims", lambda c: ~cited(c)), lambda c: F.struct(F.left(c["statement"], F.lit(80)).alias("topic"), F.lit(V.NOTES["uncited"]).alias("reason"), F.lit(V.NOTES["uncited action"]).alias("action")))
    s = s.withColumn("dropped", F.size("claims")).withColumn("unsupported", F.concat("unsupported", lost.cast(NOTE))).withColumn("claims", F.filter("claims", cited)).withColumn("dropped", F.col("dropped") - F.size("claims"))
    few = (F.size("unsupported") > 0) & (F.size("unsupported") >= F.greatest(F.lit(1), F.size("claims")))
    status = F.when((F.col("dropped") > 0) & (F.size("claims") == 0), "insufficient_evidence").when((F.col("status") == "supported") & few, "partially_supported").otherwise(F.col("status"))
    return s.withColumn("status", status)


def page(s: DataFrame) -> DataFrame:
    """(query_id, page): the synthesis as text."""
    cite = lambda c: F.concat(F.lit("   - citation: "), c["doc_id"], F.lit(" · chunk "), c["chunk_id"].cast("string"))
    why = lambda c: F.when(c["strength"] == "direct_metric", V.NOTES["direct"]).otherwise(V.NOTES["summary"])
    claims = F.transform("claims", lambda c: F.concat(c["pos"].cast("string"), F.lit(". "), c["statement"], F.lit(" ("), why(c), F.lit(")"), F.when(c["doc_id"].isNotNull(), F.concat(F.lit("\n"), cite(c))).otherwise("")))
    metrics = F.transform("metrics", lambda m: F.concat(F.lit("- "), m["label"], F.lit("="), m["value"], F.lit(" ("), m["model"], F.lit(", "), m["dataset"], F.lit(", chunk "), m["chunk_id"].cast("string"), F.lit(" in "), m["doc_id"], F.lit(")")))
    topics = F.transform("unsupported", lambda u: F.concat(F.lit("- "), u["topic"], F.lit(": "), u["reason"], F.lit(" (suggestion: "), u["action"], F.lit(")")))
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    section = lambda name, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n\n## {name}\n"), F.array_join(rows, "\n"))).otherwise("")
    none = F.when(F.size("claims") == 0, F.lit("\n\n## Supported claims\nNo supported claims; see unsupported topics below.")).otherwise("")
    foot = F.concat(F.lit("\n\nCoverage: "), F.col("total_passages").cast("string"), F.lit(" passages | "), F.col("metric_candidates").cast("string"), F.lit(" metrics | render status: "), "status")
    parts = [F.concat(F.lit("Query: "), "query"), none, section("Supported claims", claims), section("Metrics", metrics), section("Unsupported topics", topics), section("Limitations", bullets("limitations")), section("Conflicts", bullets("conflicts")), foot]
    return s.select("query_id", F.concat(*parts).alias("page"))
