"""Text functions as column expressions. ``(?U)`` gives the Unicode classes that the semantics ask for."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import values as V


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for all places where f uses it."""
    return F.transform(F.array(value), f)[0]


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring."""
    return _any([F.contains(text, F.lit(w)) for w in words])


def count_any(text: Column, words: list[str]) -> Column:
    """How many of the words are substrings."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


#: White space by Unicode: what ``(?U)\s`` matches.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Glued numbers apart, runs of blanks and of line feeds cut down, ends stripped."""
    c = F.replace(c, F.lit(" "), F.lit(" "))
    c = F.regexp_replace(c, r"(?U)(\d+\.\d+)-(?=\d)", "$1 - ")
    c = F.regexp_replace(c, r"(?U)(\d)([A-Za-z])", "$1 $2")
    c = F.regexp_replace(c, r"(?U)([A-Za-z%])(\d)", "$1 $2")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_text(c: Column) -> Column:
    """NFKC (in Arrow batches, for non-ASCII text only), hyphenated line breaks joined, Greek letters named, blanks cut down."""
    c = F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)
    c = F.replace(c, F.lit(" "), F.lit(" "))
    c = F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    letters = [chr(0x3B1 + i) for i in range(25) if i not in (14, 17)]
    for letter, name in zip(letters, V.GREEK):
        c = F.replace(F.replace(c, F.lit(letter), F.lit(name)), F.lit(letter.upper()), F.lit(name))
    c = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tokenize(c: Column) -> Column:
    """Lower-case tokens of two characters or more; inner and trailing signs ``_+-./`` stay."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9_+\-./ ]+", " "), " +"), lambda t: F.length(t) >= 2)


def code_tokens(c: Column) -> Column:
    """Identifiers: rs numbers, sequence names, code-like and hyphenated words."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(rs\d+|[cgp]\.[0-9a-z_\-+>=()\[\].:/]+|[a-z]{1,4}\d{1,6}(?:\.\d+)?|[a-z0-9]+(?:[-_/.][a-z0-9]+)+|[a-z0-9]{2,})"), F.lit(1))


def short_tokens(c: Column) -> Column:
    """Every run of two to four capitals that stands alone, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z]{2,4})\b"), F.lit(1)), F.lower)


def long_form(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in V.LONG_FORMS.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(c)), F.lit(""))


def fingerprint(c: Column) -> Column:
    return F.sha1(strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")))


def query_terms(c: Column) -> Column:
    """Distinct alphanumeric words of five characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 5)))


def evidence_words(c: Column) -> Column:
    """Distinct alphanumeric words longer than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 2))


def informative(terms: Column, mode: str | None) -> Column:
    """Terms that aren't keywords of the mode, stop words, or short ones of no standing."""
    skip = F.array(*map(F.lit, [*V.MODE_KEYWORDS.get(mode or "", []), *V.QUERY_STOPWORDS]))
    short = F.array(*map(F.lit, V.SHORT_TOKENS))
    return F.filter(terms, lambda t: ~F.array_contains(skip, t) & ((F.length(t) >= 5) | F.array_contains(short, F.lower(t))))


def key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def metric_intent(terms: Column, words: list[str] = V.METRIC_QUERY_TERMS) -> Column:
    return F.arrays_overlap(F.transform(terms, key), F.array(*map(F.lit, words)))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def summary(c: Column, prefer_metrics: Column) -> Column:
    """First sentence of six words or more (with metrics, the first that hints at one), else up to two hinting lines; 280 characters; null if none."""
    hint = r"(?i)(p\s*=\s*[\d\.e-]+|auc|aupr|kl divergence|accuracy|precision|recall|baseline)"
    long = F.filter(sentences(c), lambda s: s.rlike(r"(?U)(?:\s++\S++){4}\s"))
    lines = F.slice(F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), strip), lambda s: s.rlike(hint)), 1, 2)

    def first(own: Column) -> Column:
        best = F.when(prefer_metrics, F.coalesce(F.get(F.filter(own, lambda s: s.rlike(hint)), F.lit(0)), F.get(own, F.lit(0)))).otherwise(F.get(own, F.lit(0)))
        hints = bound(lines, lambda some: F.when(F.size(some) > 0, F.left(F.array_join(some, " "), F.lit(280))))
        return F.when(F.size(own) > 0, F.left(best, F.lit(280))).otherwise(hints)

    return bound(long, first)


def title(c: Column, stem: Column) -> Column:
    first = strip(F.get(F.split(c, "\n"), F.lit(0)))
    return F.when(F.length(first).between(6, 120), first).otherwise(stem)


def excerpt(c: Column, limit: int = 320) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.left(c, F.lit(limit - 3)), r"(?U)\s+$", ""), F.lit("...")))


def citation(doc: Column, page: Column, chunk: Column, table: Column) -> Column:
    place = F.coalesce(F.concat(F.lit("p."), page.cast("string")), F.lit("no-page"))
    return F.concat(F.lit("[CITE doc="), doc, F.lit(" "), place, F.lit(" chunk="), chunk.cast("string"), F.when(table, " [TABLE/FIG]").otherwise(""), F.lit("]"))


def dois(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(10\.\d{4,9}/[^\s\"'<>]+)"), F.lit(1)), key)


def canonical_hgvs(c: Column) -> Column:
    c = F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)
    bare = F.regexp_replace(F.translate(c, "".join(V.DASHES), "-" * len(V.DASHES)), "[() ]", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "Unknown").otherwise(F.concat(F.lower(F.left(bare, F.lit(2))), F.upper(F.substr(bare, F.lit(3)))))


def rewrite(query: Column, mode: Column) -> Column:
    tag = F.concat(F.lit("["), mode, F.lit("]"))
    return F.when(F.startswith(query, tag), query).otherwise(F.concat(tag, F.lit(" "), query))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tag(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def safe_filename(c: Column) -> Column:
    out = F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")
    return F.when(out == "", "document").otherwise(out)


def embed_text(text: Column, summary_: Column) -> Column:
    """What is embedded of a passage: short texts whole, else the summary, else the first 1600 characters."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.coalesce(summary_, F.lit(""))).when(F.length(text) <= 1600, text).otherwise(F.coalesce(F.nullif(summary_, F.lit("")), F.left(text, F.lit(1600))))


def overlap(terms: Column, searchable: Column) -> Column:
    """Share of the distinct terms that are substrings; 1 without terms, 0 without text."""
    t = F.array_distinct(F.filter(terms, lambda x: x != ""))
    hits = F.size(F.filter(t, lambda x: F.instr(searchable, x) > 0))
    return F.when(F.coalesce(F.size(t), F.lit(0)) < 1, 1.0).when(strip(searchable) == "", 0.0).otherwise(hits / F.size(t))
