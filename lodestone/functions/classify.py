"""Classification of passages and documents, and noise, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Nd}]+", ""))


def lines(c: Column) -> Column:
    """Lines without outer blanks, empty ones left out."""
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), X.strip), lambda s: s != "")


def is_table_or_figure(c: Column) -> Column:
    """A numbered table or figure is named early, most lines have cells, or numbers crowd a short text."""
    rows = F.split(c, "\n")
    cells = F.size(F.filter(rows, lambda s: F.contains(s, F.lit("\t")) | F.contains(s, F.lit("|"))))
    numbers = F.regexp_count(c, F.lit(r"(?U)\d+\.?\d*"))
    return F.left(c, F.lit(200)).rlike(r"(?iU)(table|figure|fig\.?)\s+\d+") | ((F.size(rows) > 2) & (cells > 0.5 * F.size(rows))) | ((numbers > 20) & (F.length(c) < 500))


def is_axis_label(line: Column) -> Column:
    low = F.lower(line)
    words = F.split(line, r"(?U)\s+")
    axis = F.array(*map(F.lit, V.AXIS_WORDS))
    bare = (F.size(words) <= 3) & ~line.rlike("[.:;,%]")
    named = F.array_contains(axis, low) | (line.rlike(r"^[A-Z][A-Za-z0-9/\- ]{0,30}$") & (F.upper(line) == line)) | F.forall(words, lambda w: F.array_contains(axis, F.lower(w)))
    return low.rlike(r"(?U)^[\d\s.,:;/\\\-–%]+$") | low.rlike(r"(?U)(?:\d+(?:\.\d+)?\s+){4,}\d") | ~low.rlike("[a-z]") | (digits(low) / F.greatest(F.length(low), F.lit(1)) > 0.55) | (bare & named)


def figure_noise(c: Column, figure: Column) -> Column:
    """Share of the lines that are axis labels (0 outside figures)."""
    share = X.bound(lines(c), lambda own: F.when(F.size(own) > 0, F.size(F.filter(own, is_axis_label)) / F.size(own)).otherwise(F.lit(0.0)))
    return F.when(figure, share).otherwise(F.lit(0.0))


def without_figure_noise(c: Column, figure: Column) -> Column:
    """Lines stripped; in figures, axis labels dropped."""
    rows = F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), X.strip)
    kept = F.filter(rows, lambda s: (s == "") | ~(figure & is_axis_label(s)))
    return X.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def chunk_type(clean: Column, table: Column, noise: Column) -> Column:
    """body, caption, table, figure_derived or mixed, by the first rule that holds. What several rules ask for is computed once."""

    def axisish(s: Column) -> Column:
        return (s.rlike("[A-Za-z]") & ~s.rlike("[A-Za-z]{5}")) | (digits(s) / F.greatest(F.length(s), F.lit(1)) > 0.6)

    def by_ratio(ratio: Column, own: Column) -> Column:
        heavy = (F.size(own) > 0) & (F.size(F.filter(own, axisish)) >= 0.5 * F.size(own))
        return F.when((ratio >= 0.65) | heavy, "figure_derived").when(ratio >= 0.45, "mixed").otherwise("body")

    def rules(x: Column) -> Column:
        own, first, head = x["own"], x["first"], x["head"]
        starts = lambda words: X._any([F.startswith(first, F.lit(w)) for w in words])
        early = lambda words: X.has_any(head, words)
        panel = first.rlike(r"^(?:panel\s+)?([a-k]|\([a-k]\)|[a-k][).:])")
        letter = F.coalesce(F.get(own, F.lit(0)).rlike("^(?i)[a-k]$"), F.lit(False))
        figure = (
            F.when(starts(V.TABLE_PREFIXES) | F.contains(F.lower(F.array_join(F.slice(own, 1, 2), " ")), F.lit("table")), "table")
            .when(starts(V.FIGURE_PREFIXES) | panel | F.contains(F.left(head, F.lit(160)), F.lit("panel")) | letter, "caption")
            .otherwise("figure_derived")
        )
        ratio = F.when(noise > 0, noise).otherwise(digits(x["clean"]) / F.greatest(F.length(x["clean"]), F.lit(1)))
        return (
            F.when(table, figure)
            .when(starts(V.TABLE_PREFIXES) | early(V.TABLE_PREFIXES), "table")
            .when(starts(V.FIGURE_PREFIXES) | early(V.FIGURE_PREFIXES) | panel, "caption")
            .otherwise(X.bound(ratio, lambda r: by_ratio(r, own)))
        )

    def facts(c: Column, own: Column) -> Column:
        return F.struct(c.alias("clean"), own.alias("own"), F.coalesce(F.lower(F.get(own, F.lit(0))), F.lit("")).alias("first"), F.left(F.lower(c), F.lit(220)).alias("head"))

    return X.bound(X.strip(clean), lambda c: X.bound(F.slice(lines(c), 1, 4), lambda own: X.bound(facts(c, own), rules)))


def doc_type(stem: Column, blob: Column) -> Column:
    """assembly, variant or paper by keyword hits in a lower-cased blob of name, title and first summaries."""
    counts = X.bound(blob, lambda b: F.struct(X.count_any(b, V.DOC_TYPE_KEYWORDS["assembly"]).alias("a"), X.count_any(b, V.DOC_TYPE_KEYWORDS["variant"]).alias("v")))
    kind = X.bound(counts, lambda n: F.when(n["a"] >= F.greatest(F.lit(2), n["v"] + 1), "assembly").when(n["v"] >= F.greatest(F.lit(2), n["a"] + 1), "variant").otherwise("paper"))
    return F.when(F.contains(F.lower(stem), F.lit("shine")), "assembly").otherwise(kind)


def is_figure_chunk(kind: Column, table: Column) -> Column:
    return table | F.lower(kind).isin("caption", "figure_derived", "table", "mixed")


def effective_noise(text: Column, kind: Column, table: Column, noise: Column) -> Column:
    own = digits(text) / F.greatest(F.length(text), F.lit(1))
    return F.when(noise > 0, noise).when(is_figure_chunk(kind, table), F.coalesce(own, F.lit(0.0))).otherwise(0.0)


def mode_context(doc_type_: Column, mode: str | None) -> Column:
    return F.lower(doc_type_).isin("paper", "unknown") if mode in (None, "", "paper") else F.lower(doc_type_) == mode


def mode_weight(searchable: Column, doc_type_: Column, mode: str | None) -> Column:
    """How well a passage suits the mode: 1 in paper mode, 0.6 without a keyword, else within 0.4 and 1.6."""
    if mode in (None, "", "paper"):
        return F.lit(1.0)
    hits, against = X.count_any(searchable, V.MODE_KEYWORDS.get(mode, [])), X.count_any(searchable, V.MODE_NEGATIVE.get(mode, []))
    kind = F.when(doc_type_ == "paper", 0.0).when(doc_type_ == mode, 0.2).otherwise(-0.25)
    weight = F.least(F.lit(1.4), 1.0 + 0.18 * hits) - F.least(F.lit(0.3), 0.1 * against) + kind
    return F.when(hits == 0, 0.6).otherwise(F.greatest(F.lit(0.4), F.least(F.lit(1.6), weight)))


def is_boilerplate(text: Column) -> Column:
    text, low = X.strip(text), F.lower(X.strip(text))
    patterns = V.BOILERPLATE
    seen = X._any([text.rlike("(?i)" + p) for p in patterns])
    names = X.has_any(low, V.BOILERPLATE_METRICS)
    meta = X.has_any(low, V.BOILERPLATE_META)
    return (text == "") | (seen & ((F.length(low) < 220) | ~names)) | (meta & (F.length(low) < 260)) | (text.rlike("(?i)" + patterns[0]) & text.rlike("(?i)" + patterns[1]))
