"""Reports of structured synthesis as nested JSON, read into a graph of claims: tables of nodes and edges.

A report is one JSON text. Unknown fields are left out. Reports that are no JSON or lack a title, coverage or audit, and
those with an item that lacks its id, become rows with a warning. Nodes and edges are made within a report's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a report.
CITATION = "struct<doc_id:string,source_path:string,chunk_id:int,page:int>"
REPORT = (
    "title string, query string, "
    "retrieval_candidates array<struct<doc_id:string,source_path:string,chunk_id:int,page:int,chunk_type:string,summary:string,kept:boolean>>, "
    f"supported_claims array<struct<id:string,statement:string,support_status:string,support_strength:string,support_reason:string,evidence_quality:string,citations:array<{CITATION}>,related_metrics:array<string>>>, "
    "unsupported_claims array<struct<id:string,topic:string,requested_terms:array<string>,reason:string,status:string,suggested_action:string>>, "
    f"limitations array<struct<id:string,kind:string,description:string,citations:array<{CITATION}>>>, "
    f"metric_summaries array<struct<id:string,metric_label:string,value:string,model:string,dataset:string,task:string,citation:{CITATION}>>, "
    "coverage struct<total_passages:int,figure_passages:int,metric_candidates:int,missing_terms:array<string>,notes:array<string>>, "
    f"conflicts array<struct<id:string,conflict_type:string,description:string,status:string,citation_refs:array<{CITATION}>,related_claim_ids:array<string>>>, "
    "audit struct<render_status:string,verifier_notes:array<string>,dropped_claim_ids:array<string>>"
)
_ITEMS = ["supported_claims", "unsupported_claims", "limitations", "metric_summaries", "conflicts"]
_LISTS = [*_ITEMS, "retrieval_candidates"]


def read_reports(texts: DataFrame, text: str = "value") -> DataFrame:
    """The other columns, a report's fields (lists are never null), and ``warning``, null where the report is sound."""
    r = F.from_json(text, REPORT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = texts.withColumn("_r", F.explode(F.array(r)))  # parsed once: a filter on what was read isn't moved below it, with all of the parsing within
    missing = F.array_compact(F.array(*(F.when(F.col(f"_r.{c}").isNull(), c) for c in ("title", "coverage", "audit"))))
    nameless = F.array_compact(F.array(*(F.when(F.exists(F.col(f"_r.{c}"), lambda x: x["id"].isNull()), c) for c in _ITEMS)))
    warning = (
        F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "not a report")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(F.size(nameless) > 0, F.concat(F.lit("no id in: "), F.array_join(nameless, ", ")))
    )
    df = df.withColumn("warning", warning)
    fields = [f.name for f in df.schema["_r"].dataType.fields if f.name != "_corrupt"]
    none = lambda c: F.array().cast(df.select(f"_r.{c}").schema[c].dataType)
    value = lambda c: F.when(F.col("warning").isNull(), F.coalesce(F.col(f"_r.{c}"), none(c)) if c in _LISTS else F.col(f"_r.{c}"))
    return df.select(*(c for c in texts.columns if c != text), *(value(c).alias(c) for c in fields), "warning")


def _passage(c: Column) -> Column:
    return F.concat_ws("#", c["doc_id"], c["chunk_id"].cast("string"))


def nodes(reports: DataFrame, key: str) -> DataFrame:
    """(key, kind, id, label, state): a node for each item of a sound report, and for each passage that it names."""
    node = lambda kind, id_, label, state: F.struct(F.lit(kind).alias("kind"), id_.alias("id"), label.alias("label"), state.alias("state"))
    none = F.lit(None).cast("string")
    cited = F.flatten(F.array(
        F.flatten(F.transform("supported_claims", lambda c: F.coalesce(c["citations"], _no_citation()))), F.flatten(F.transform("limitations", lambda c: F.coalesce(c["citations"], _no_citation()))),
        F.flatten(F.transform("conflicts", lambda c: F.coalesce(c["citation_refs"], _no_citation()))), F.filter(F.transform("metric_summaries", lambda m: m["citation"]), lambda c: c.isNotNull()),
        F.transform("retrieval_candidates", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["source_path"].alias("source_path"), c["chunk_id"].alias("chunk_id"), c["page"].alias("page"))),
    ))
    all_ = F.concat(
        F.array(node("report", F.lit("report"), F.col("title"), F.col("audit.render_status"))),
        F.transform("supported_claims", lambda c: node("claim", c["id"], c["statement"], c["support_status"])),
        F.transform("unsupported_claims", lambda c: node("unsupported", c["id"], c["topic"], c["status"])),
        F.transform("limitations", lambda c: node("limitation", c["id"], c["description"], c["kind"])),
        F.transform("metric_summaries", lambda m: node("metric", m["id"], F.concat_ws("=", m["metric_label"], m["value"]), m["dataset"])),
        F.transform("conflicts", lambda c: node("conflict", c["id"], c["description"], c["status"])),
        F.array_distinct(F.transform(cited, lambda c: node("passage", _passage(c), c["doc_id"], none))),
    )
    return reports.where("warning is null").select(key, F.inline(all_))


def _no_citation() -> Column:
    return F.array().cast(f"array<{CITATION}>")


def edges(reports: DataFrame, key: str) -> DataFrame:
    """(key, source, relation, target): what a report holds, cites, uses, is about, kept, left out and dropped."""
    edge = lambda s, r, t: F.struct(s.alias("source"), F.lit(r).alias("relation"), t.alias("target"))
    report = F.lit("report")
    each = lambda items, name, relation: F.flatten(F.transform(items, lambda x: F.transform(F.coalesce(x[name], F.array().cast("array<string>")), lambda t: edge(x["id"], relation, t))))
    cites = lambda items, name: F.flatten(F.transform(items, lambda x: F.transform(F.coalesce(x[name], _no_citation()), lambda c: edge(x["id"], "cites", _passage(c)))))
    all_ = F.concat(
        *(F.transform(c, lambda x: edge(report, "holds", x["id"])) for c in _ITEMS),
        cites("supported_claims", "citations"), cites("limitations", "citations"), cites("conflicts", "citation_refs"),
        F.transform(F.filter("metric_summaries", lambda m: m["citation"].isNotNull()), lambda m: edge(m["id"], "cites", _passage(m["citation"]))),
        each("supported_claims", "related_metrics", "uses"), each("conflicts", "related_claim_ids", "about"),
        F.transform("retrieval_candidates", lambda c: F.struct(report.alias("source"), F.when(F.coalesce(c["kept"], F.lit(True)), "kept").otherwise("left out").alias("relation"), _passage(c).alias("target"))),
        F.transform(F.coalesce("audit.dropped_claim_ids", F.array().cast("array<string>")), lambda t: edge(report, "dropped", t)),
    )
    return reports.where("warning is null").select(key, F.inline(all_))
