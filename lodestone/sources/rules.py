"""Rules for loaded tables, checked in one pass: every violation is a row, and a loader may refuse a table that has any.

Rules on fields are looked at together within a row; rules of uniqueness count their fields' values with map-side sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X

# The fields of a benchmark item, and what some of them may hold.
ITEM_FIELDS = ["id", "question", "source_doc", "source_doc_slug", "benchmark_track", "gold_answer", "expected_audit_state", "supporting_section_or_page", "supporting_quote_or_paraphrase", "candidate_supporting_section", "candidate_supporting_quote_or_paraphrase", "unsupported_reason", "task_type", "verification_status", "human_verified_by", "human_verified_date", "notes"]
AUDIT_STATES = ["supported", "partially_supported", "insufficient_evidence", "conflicting_evidence", "off_target_evidence"]
TRACKS = ["core_paper_mode_general", "assembly_qc_specialized"]
TASK_TYPES = ["scoped_document_query", "metric_extraction_query", "supported_claim_query", "unsupported_topic_query", "limitation_conflict_query"]
VERIFICATION = ["needs_human_review", "human_verified"]


@dataclass(frozen=True)
class Rule:
    """``kind``: present (not null), filled (not blank), done (not blank, no TODO), one_of, one_of_or_todo, or unique."""

    field: str
    kind: str
    allowed: tuple[str, ...] = ()


def is_todo(c: Column) -> Column:
    """Blank, or begins with TODO."""
    bare = F.lower(X.strip(F.coalesce(c, F.lit(""))))
    return (bare == "") | F.startswith(bare, F.lit("todo"))


def _broken(rule: Rule) -> Column:
    c = F.col(rule.field).cast("string")
    blank = X.strip(F.coalesce(c, F.lit(""))) == ""
    other = ~F.coalesce(c, F.lit("")).isin(*rule.allowed) if rule.allowed else F.lit(True)
    # A field that isn't there is the business of its rule of presence.
    return {"present": c.isNull(), "filled": blank, "done": is_todo(c), "one_of": c.isNotNull() & other, "one_of_or_todo": ~is_todo(c) & other}[rule.kind]


def violations(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, field, rule, value): one row for each rule that a row breaks, all rules at once."""
    said = lambda r: F.struct(F.lit(r.field).alias("field"), F.lit(r.kind).alias("rule"), F.col(r.field).cast("string").alias("value"))
    inner = [r for r in rules if r.kind != "unique"]
    out = rows.select(F.col(key).cast("string").alias("key"), F.inline(F.array_compact(F.array(*(F.when(_broken(r), said(r)) for r in inner))))) if inner else None
    for r in rules:
        if r.kind == "unique":
            twice = rows.groupBy(F.col(r.field).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1 and value is not null")
            own = rows.select(F.col(key).cast("string").alias("key"), F.lit(r.field).alias("field"), F.lit("unique").alias("rule"), F.col(r.field).cast("string").alias("value"))
            found = own.join(twice.select("value"), "value", "left_semi").select("key", "field", "rule", "value")
            out = found if out is None else out.unionByName(found)
    return out


class Refused(ValueError):
    """A table breaks its rules."""


def refuse(found: DataFrame, what: str) -> None:
    if rows := found.limit(5).collect():
        raise Refused(f"{what}: " + "; ".join(f"{r['key']}: {r['field']} ({r['rule']}) is {r['value']!r}" for r in rows))


BENCHMARK_RULES = [
    *(Rule(f, "present") for f in ITEM_FIELDS), Rule("id", "unique"),
    Rule("expected_audit_state", "one_of_or_todo", tuple(AUDIT_STATES)), Rule("benchmark_track", "one_of", tuple(TRACKS)),
    Rule("task_type", "one_of_or_todo", tuple(TASK_TYPES)), Rule("verification_status", "one_of_or_todo", tuple(VERIFICATION)),
]
READY_RULES = [
    Rule("verification_status", "one_of", ("human_verified",)),
    *(Rule(f, "done") for f in ("gold_answer", "expected_audit_state", "supporting_section_or_page", "supporting_quote_or_paraphrase")),
    Rule("human_verified_by", "filled"), Rule("human_verified_date", "filled"),
]


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, violations) of a benchmark file: one row an item, all fields as trimmed text. A file without a list of items is refused."""
    schema = "items array<struct<" + ",".join(f"{f}:string" for f in ITEM_FIELDS) + ">>, schema_version string, benchmark_name string"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    if raw.where("items is null").limit(1).count():
        raise Refused(f"{path}: no list of items")
    items = raw.select(F.posexplode("items").alias("pos", "i")).select("pos", *(X.strip(F.col(f"i.{f}")).alias(f) for f in ITEM_FIELDS))
    return items, violations(items, "id", BENCHMARK_RULES)


def scoring_ready(items: DataFrame) -> DataFrame:
    """What keeps a benchmark from being scored; a benchmark without items breaks a rule of its own."""
    none = items.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("benchmark").alias("key"), F.lit("items").alias("field"), F.lit("filled").alias("rule"), F.lit(None).cast("string").alias("value"))
    return violations(items, "id", READY_RULES).unionByName(none)


def manifest_papers(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((slug, title, benchmark_track, source_url), violations) of a manifest's rows: those without slug or title are skipped, no track means the first."""
    text = lambda c: X.strip(F.coalesce(F.col(c), F.lit("")))
    own = documents.select(text("slug").alias("slug"), text("title").alias("title"), F.coalesce(F.nullif(text("benchmark_track"), F.lit("")), F.lit(TRACKS[0])).alias("benchmark_track"), text("source_url").alias("source_url"))
    own = own.where("slug <> '' and title <> ''")
    return own, violations(own, "slug", [Rule("benchmark_track", "one_of", tuple(TRACKS))])
