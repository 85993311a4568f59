"""Command lines, session arguments and previews on literal rows."""

import datetime

from pyspark.sql import functions as F

from lodestone.functions import dialogue as D


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_commands(spark):
    lines = {"Find BRCA1 papers": ("search", "BRCA1 papers"), "/Add  x y": ("add", "x y"), "cite 3": ("cite", "3"), "add note hi": ("add", "note hi"), "list notes": ("notes", ""), "use mode paper": ("mode", "paper"), "session save a --desc b": ("session_save", "a --desc b"), "?": ("help", ""), "what is it": ("chat", "what is it"), "": ("chat", "")}
    rows = spark.createDataFrame([(k,) for k in lines], "t string").select("t", D.command(F.col("t")).alias("c")).collect()
    assert {r.t: (r.c.command, r.c.args) for r in rows} == lines


def test_arguments_and_names(spark):
    got = one(spark, D.session_args(F.lit('run 1 --desc="a b"')), D.session_args(F.lit(" plain ")), D.snapshot_name(F.lit("__a b!__")), D.snapshot_name(F.lit("!!")), D.without_timestamp(F.lit("paper-1712345678")), D.shorten(F.lit("x" * 100), 10))
    assert (got.c0.name, got.c0.description, got.c1.name, got.c1.description) == ("run 1", "a b", "plain", "")
    assert (got.c2, got.c3, got.c4, got.c5) == ("a_b", None, "paper", "xxxxxxx...")
    when = one(spark, D.timestamp(F.lit("2026-05-03T10:00:00Z"), F.lit(None).cast("timestamp")), D.timestamp(F.lit("no"), F.lit("2020-01-01").cast("timestamp")))
    assert when.c0.hour == 10 and when.c1 == datetime.datetime(2020, 1, 1)


def test_previews(spark):
    got = one(spark, D.preview(F.lit("and a fragment. This is the first whole sentence. More.")), D.preview(F.lit("  ")), D.highlight_terms(F.lit("The p53 of 12 the AUC")), D.without_stray_lines(F.lit("a\nText\n1.0 2\nMore")), D.key_values(F.lit("k: v\nlong key: w: x")), D.key_values(F.lit("no pairs")), D.metric_sentences(F.lit("Intro. The accuracy was 0.9. End.")), D.digest(F.lit("One. Two. Three."), F.lit(None).cast("string"), F.lit("t")))
    assert (got.c0, got.c1, got.c2, got.c3) == ("This is the first whole sentence.", "(no preview)", ["the", "p53", "12", "auc"], "Text\nMore")
    assert [tuple(p) for p in got.c4] == [("k", "v"), ("long key", "w: x")] and got.c5 is None and got.c6 == ["The accuracy was 0.9."] and got.c7 == "One. Two."
