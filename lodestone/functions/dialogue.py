"""Command lines, session arguments and preview texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Command patterns in the order of their precedence; the first group is the argument.
COMMANDS = [
    (r"(?:search|find|look for|lookup)\s+(.+)", "search"),
    (r"cite\s+(\d+)", "cite"),
    (r"cite\s+(?:result|passage|retrieval)\s*(\d+)", "cite"),
    (r"expand\s+(\d+)", "expand"),
    (r"add (.*)", "add"),
    (r"(?:show |list )?modes()", "modes"),
    (r"(?:show |list )?templates()", "templates"),
    (r"(?:show |list )?notes()", "notes"),
    (r"(?:show |list )?library()", "library"),
    (r"inbox\S*\s*(.*)", "inbox"),
    (r"(?:show inbox|inbox status)()", "inbox"),
    (r"details\S*\s*(.*)", "details"),
    (r"report (.*)", "report"),
    (r"recent\S*\s*(.*)", "recent"),
    (r"watch downloads\S*\s*(.*)", "watch_downloads"),
    (r"(?:show |list )?sessions()", "sessions"),
    (r"(?:use|switch to|activate)\s+mode\s+(\d+|paper|assembly|variant)", "mode"),
    (r"mode\s+(\d+|paper|assembly|variant)", "mode"),
    (r"mode()", "mode"),
    (r"template\s+(\d+)", "template"),
    (r"template (off)", "template"),
    (r"template()", "templates"),
    (r"search[ _]?method()", "search_method"),
    (r"search[ _]method\s+(tfidf|bm25)", "search_method"),
    (r"rebuild[ _]?index()", "rebuild_index"),
    (r"note (.*)", "note"),
    (r"session save(.*)", "session_save"),
    (r"session load(.*)", "session_load"),
    (r"session delete(.*)", "session_delete"),
    (r"(?:auto dissect|dissect|dissect paper)()", "dissect"),
    (r"qc[ _]?report()", "qc_report"),
    (r"(?:eval[ _]?plan|evaluation plan)()", "eval_plan"),
    (r"(?:clear|clear history|reset)()", "clear"),
    (r"(?:save|save session)()", "save"),
    (r"(?:help|commands|\?)()", "help"),
    (r"(?:show )?model()", "model"),
    (r"(?:exit|quit|bye|goodbye)()", "exit"),
]
# Words of a sentence that reports a metric.
METRIC_WORDS = ["accuracy", "precision", "recall", "auc", "aupr", "f1", "n50", "busco", "completeness", "specificity", "sensitivity", "%"]


def command(line: Column) -> Column:
    """struct<command, args> of a line: a slash command, else the first pattern that the whole line fits, else chat."""
    t = X.strip(line)
    table = F.array(*(F.struct(F.lit(rf"(?is)^{p}$").alias("pattern"), F.lit(c).alias("command")) for p, c in COMMANDS))
    hit = F.get(F.filter(table, lambda p: F.regexp_like(t, p["pattern"])), F.lit(0))
    own = F.when(hit.isNotNull(), X.strip(F.call_function("regexp_extract", t, hit["pattern"], F.lit(1)))).otherwise(t)
    slash = F.startswith(t, F.lit("/"))
    name = F.when(slash, F.lower(F.regexp_extract(t, r"(?s)^/\s*(\S+)", 1))).otherwise(F.coalesce(hit["command"], F.lit("chat")))
    return F.struct(name.alias("command"), F.when(slash, F.regexp_extract(t, r"(?s)^/\s*\S+\s+(.*)$", 1)).otherwise(own).alias("args"))


def session_args(args: Column) -> Column:
    """struct<name, description> of ``name --desc "text"``."""
    at = F.instr(args, F.lit("--desc"))
    raw = X.strip(F.regexp_replace(X.strip(F.substr(args, at + 6)), "^=", ""))
    bare = F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.struct(X.strip(F.when(at > 0, F.substr(args, F.lit(1), at - 1)).otherwise(args)).alias("name"), F.when(at > 0, bare).otherwise("").alias("description"))


def snapshot_name(c: Column) -> Column:
    """A stored name: other characters become ``_``, none at the ends, 64 at most; null if nothing is left."""
    return F.nullif(F.left(F.regexp_replace(F.regexp_replace(X.strip(c), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit(64)), F.lit(""))


def shorten(c: Column, limit: int = 80) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(limit - 3)), F.lit("...")))


def preview(c: Column) -> Column:
    """The first whole sentence: five words or more, not beginning in lower case; else the first two fragments, shortened."""
    own = X.sentences(F.regexp_replace(X.strip(c), r"(?U)\s+", " "))
    whole = F.get(F.filter(own, lambda s: (F.size(F.split(s, " ")) >= 5) & ~s.rlike(r"^\P{L}*\p{Ll}")), F.lit(0))
    ended = F.when(whole.rlike(r"[.!?]$"), whole).otherwise(F.concat(whole, F.lit("...")))
    return F.when(F.size(own) == 0, "(no preview)").otherwise(F.coalesce(ended, shorten(F.array_join(F.slice(own, 1, 2), " "), 220)))


def highlight_terms(c: Column) -> Column:
    """Distinct terms of a query in order: three characters or more, or all digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9][a-z0-9._+/-]*)"), F.lit(1)), lambda t: (F.length(t) >= 3) | t.rlike("^[0-9]+$")))


def without_stray_lines(c: Column) -> Column:
    """Lines of one letter or of numbers only left out."""
    kept = F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), X.strip), lambda s: ~s.rlike("^[a-z]$") & ~s.rlike(r"^[0-9.\s]+$"))
    return X.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def key_values(c: Column) -> Column:
    """A map of a block whose two lines or more all read ``key: value`` with keys up to 40 characters; else null."""
    rows = F.filter(F.transform(F.split(c, "\n"), X.strip), lambda s: s != "")
    pair = lambda s: F.struct(X.strip(F.regexp_extract(s, "^([^:]*):", 1)), X.strip(F.regexp_extract(s, "^[^:]*:(.*)$", 1)))
    fits = (F.size(rows) >= 2) & F.forall(rows, lambda s: F.instr(s, F.lit(":")).between(2, 41))
    return F.when(fits, F.transform(rows, pair))


def metric_sentences(c: Column, limit: int = 3) -> Column:
    """Sentences with a metric's word and a number; else the first ones."""
    own = X.sentences(F.replace(c, F.lit("\n"), F.lit(" ")))
    hits = F.filter(own, lambda s: X.has_any(F.lower(s), METRIC_WORDS) & s.rlike(r"\d"))
    return F.slice(F.when(F.size(hits) > 0, hits).otherwise(own), 1, limit)


def digest(first: Column, second: Column, title: Column) -> Column:
    """The first two sentences of a document's first two passages; else its title."""
    own = F.slice(F.concat(X.sentences(F.coalesce(first, F.lit(""))), X.sentences(F.coalesce(second, F.lit("")))), 1, 2)
    return F.coalesce(F.nullif(F.array_join(own, " "), F.lit("")), title)


def without_timestamp(stem: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stem, r"[-_]\d{9,}$", ""), r"[-_]20\d{2}[-_]\d{2}[-_]\d{2}(?:[-_]\d{2}[-_]\d{2}[-_]\d{2})?$", "")


def timestamp(c: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")), fallback)
