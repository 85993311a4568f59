"""Spans of a text that a query asks to be marked, as offsets, and the text with them marked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Words of a query that have numbers marked, and what is marked whatever is asked.
NUMBER_WORDS = ["metric", "metrics", "auc", "auroc", "accuracy", "precision", "recall", "f1", "mcc", "aupr", "ap"]
NUMBER = r"(?U)\d+(?:\.\d+)?%?"
DETAILS = [r"(?iU)\bpathogenic(?:ity)?\b", r"(?iU)\bbenign\b", r"(?iU)\bVUS\b", r"(?iU)\bClinVar\b", r"(?iU)\bPLL?R\b", r"(?iU)\bKL divergence\b"]

SPANS = "array<struct<start:int,end:int,style:string>>"


def query_terms(query: Column) -> Column:
    """Distinct tokens of three characters or more, or of digits, in their order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9._+/-]*)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) | t.rlike(r"^\d+$")))


def matches(text: Column, pattern: Column, style: Column) -> Column:
    """(start, end, style) of each match, in order: what lies between matches tells where they are."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["before"])
        end = begin + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), style.alias("style")))).alias("spans"))

    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda a, b: F.struct(a.alias("before"), b.alias("match")))
    return F.aggregate(pairs, start, step, lambda s: s["spans"])


def spans(text: Column, query: Column) -> Column:
    """All spans: numbers if the query has a word of metrics, fixed terms, then the query's terms by their number."""
    asks = X.has_any(F.lower(F.coalesce(query, F.lit(""))), NUMBER_WORDS)
    numbers = F.when(asks, matches(text, F.lit(NUMBER), F.lit("number"))).otherwise(F.array().cast(SPANS))
    details = [matches(text, F.lit(p), F.lit(f"detail {i}")) for i, p in enumerate(DETAILS)]
    # A term holds no \E: its signs are those that its pattern lets in.
    own = F.transform(query_terms(query), lambda t, i: matches(text, F.concat(F.lit(r"(?iu)\Q"), t, F.lit(r"\E")), F.concat(F.lit("term "), i.cast("string"))))
    return F.concat(numbers, *details, F.flatten(own))


def merged(found: Column) -> Column:
    """(start, end) of what the spans cover together; those that touch or overlap are one."""
    last = lambda s: F.element_at(s, -1)
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def step(s: Column, x: Column) -> Column:
        joins = (F.size(s) > 0) & (F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(-1)) >= x["start"])
        widened = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(pair(last(s)["start"], F.greatest(last(s)["end"], x["end"]))))
        return F.when(joins, widened).otherwise(F.concat(s, F.array(pair(x["start"], x["end"]))))

    return F.aggregate(F.array_sort(found), F.array().cast("array<struct<start:int,end:int>>"), step)


def marked(text: Column, found: Column, before: str = "**", after: str = "**") -> Column:
    """The text with each covered stretch between marks."""
    step = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["t"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(before), F.substr(text, x["start"] + 1, x["end"] - x["start"]), F.lit(after)).alias("t"))
    return F.aggregate(merged(found), F.struct(F.lit(0).alias("at"), F.lit("").alias("t")), step, lambda s: F.concat(s["t"], F.substr(text, s["at"] + 1, F.length(text))))
