"""Passages are annotated without computing the same value again for each rule."""

import re

from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import retrieval as R


def test_what_several_rules_ask_for_is_computed_once(spark):
    p = R.annotate(spark.createDataFrame([(1, 0, "x")], "doc_id int, chunk_id int, text string"))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") <= 16  # 73 when the type's rules each split the lines again


def test_ends_are_stripped_as_the_pattern_does(spark):
    texts = [t for i in range(1, 0x3100) for t in (chr(i), f"{chr(i)}a {chr(i)}b\n{chr(i)}")] + ["", " \n", "\U0001f600 ", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert d.where(~X.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def by_loops(clean, table, noise):
    digits = lambda s: sum(c.isdecimal() for c in s) / max(len(s), 1)
    own = [s for s in (x.strip() for x in clean.strip().splitlines()) if s][:4]
    first, low = own[0].lower() if own else "", clean.strip().lower()
    starts = lambda words: first.startswith(tuple(words))
    early = lambda words: any(w in low[:220] for w in words)
    panel = bool(re.match(r"(?:panel\s+)?([a-k]|\([a-k]\)|[a-k][).:])", first))
    if table:
        if starts(V.TABLE_PREFIXES) or "table" in " ".join(own[:2]).lower():
            return "table"
        return "caption" if starts(V.FIGURE_PREFIXES) or panel or "panel" in low[:160] else "figure_derived"
    if starts(V.TABLE_PREFIXES) or early(V.TABLE_PREFIXES):
        return "table"
    if starts(V.FIGURE_PREFIXES) or early(V.FIGURE_PREFIXES) or panel:
        return "caption"
    ratio = noise if noise > 0 else digits(clean.strip())
    short = lambda s: (w := re.findall("[A-Za-z]+", s)) and all(len(x) <= 4 for x in w)
    if ratio >= 0.65 or (own and sum(bool(digits(s) > 0.6 or short(s)) for s in own) >= 0.5 * len(own)):
        return "figure_derived"
    return "mixed" if ratio >= 0.45 else "body"


def test_types_of_passages_as_by_loops(spark):
    texts = ["Words of some length\nsecond sentence here", "one two it is\nno", "Table 1 of it", "zzzz\nwwww 123456789 zzzzzz", "sentence 123456 78 zz", "(b) the panel", "stands near a table", "zzzzz figure 3", "", " \n ", "zzzzz\n\nzzz zz\n12345\nlonger lines"]
    cases = [(i, t, table, noise) for i, (t, table, noise) in enumerate((t, table, noise) for t in texts for table in (False, True) for noise in (0.0, 0.5, 0.7))]
    d = spark.createDataFrame(cases, "i int, t string, f boolean, n double")
    got = d.select("i", C.chunk_type(F.col("t"), F.col("f"), F.col("n")).alias("kind")).orderBy("i").collect()
    want = [by_loops(t, table, noise) for _, t, table, noise in cases]
    assert [r["kind"] for r in got] == want and set(want) == {"body", "caption", "table", "figure_derived", "mixed"}
