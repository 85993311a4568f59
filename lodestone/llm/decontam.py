"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

``index`` reads the corpus once and writes postings (term, row, position) of the test items' terms to the shared
folder, and beside them one line for each row with its number of words; rows get their names in that pass, so they
hold for all that follows. A posting's position less its term's offset in an item is where the item would begin. From
the two rarest terms of each of an item's windows such starts are made and intersected: a start that holds a window
stands in both lists. The starts that are left are then intersected with the offset-adjusted lists of all of the
item's terms, and runs of a window's length and more are the exact matches. ``proximity`` intersects the same lists
with a slop. Texts are not looked at again, and no row's words travel.

Starts are broadcast to the postings when their counted number is within ``MOST_BROADCAST``; more are joined by
Spark's own choice, and skewed rows are split by adaptive execution. The vocabulary of the items is treated alike.

Edge cases: a null or empty text has no words and no hit; an item without words is never found; items with
fewer words than a window are one window; an item id of null hits words but isn't listed; equal items are found
together; repeated rows each get their row; an empty benchmark hits nothing; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

WINDOW = 10
#: Rows of terms, windows or starts that are broadcast.
MOST_BROADCAST = 1_000_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ends every row's words; it can't be a word, and its posting is the row's own line.
_END = "\x00"


def words(text: str) -> Column:
    """Lower-cased words; an empty string stands first or last where the text begins or ends between words."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.split(lower, _GAP)


def n_words(w: Column) -> Column:
    edge = lambda at: F.when(F.element_at(w, at) == "", 1).otherwise(0)
    return (F.size(w) - edge(1) - F.when(F.size(w) > 1, edge(-1)).otherwise(0)).cast("long")


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The table, marked for broadcast if it has no more rows than the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def distinct_items(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, terms, items): each distinct sequence of words with a number and the ids that hold it."""
    own = items.select(F.col(item_col).cast("string").alias("id"), F.filter(words(text_col), lambda x: x != "").alias("terms")).where(F.size("terms") > 0)
    return stored(own.groupBy("terms").agg(F.sort_array(F.collect_set("id")).alias("items")).withColumn("item", F.monotonically_increasing_id()), "items")


def index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((row, id, n_words) of each row, (row, t, pos) postings, (term, t)) for a table of terms; the positions count words."""
    named = stored(terms.distinct().select("term", F.monotonically_increasing_id().alias("t")), "terms")
    wanted = named.union(docs.sparkSession.sql("select '\\u0000' term, -1L t"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(text_col).alias("w"))
    lead = F.when(F.element_at("w", 1) == "", 1).otherwise(0)
    each = rows.select("row", "id", lead.alias("lead"), n_words(F.col("w")).alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit(_END)))).alias("pos", "term"))
    own = F.col("t") == -1
    found = each.join(small(wanted), "term").select("row", "t", (F.col("pos") - F.col("lead")).alias("pos"), F.when(own, F.col("id")).alias("id"), F.when(own, F.col("n_words")).alias("n_words"), own.cast("int").alias("own"))
    back = stored(found, "postings", by="own")
    return back.where("own = 1").select("row", "id", "n_words"), back.where("own = 0").select("row", "t", "pos"), named


def ranked_terms(items: DataFrame, postings: DataFrame, named: DataFrame) -> DataFrame:
    """(item, offset, t, n, size) of each item's terms that occur; n is the number of postings."""
    counts = postings.groupBy("t").agg(F.count("*").alias("n"))
    each = items.select("item", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    return each.join(named, "term").join(counts, "t").select("item", "offset", "t", "n", "size")


def rarest(ranked: DataFrame, size: int) -> DataFrame:
    """(item, offset, t): the two rarest terms of each window of the items that has all its terms."""
    x = F.struct("n", "offset", "t")
    by = ranked.groupBy("item", "size").agg(F.array_sort(F.collect_list(F.struct("offset", x.alias("x")))).alias("by"))
    width = F.least(F.col("size"), F.lit(size))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("by") - width + 1, F.lit(1))), lambda i: F.slice("by", i, width))
    whole = F.filter(cuts, lambda w: (F.size(w) == width) & (F.element_at(w, -1)["offset"] - F.element_at(w, 1)["offset"] == width - 1))
    two = F.flatten(F.transform(whole, lambda w: F.slice(F.array_sort(F.transform(w, lambda y: y["x"])), 1, 2)))
    return by.select("item", F.explode(F.array_distinct(two)).alias("y")).select("item", "y.offset", "y.t")


def phrases(postings: DataFrame, ranked: DataFrame, size: int) -> DataFrame:
    """(row, item, a, b): the runs of a window's length and more of an item's words that stand in a row, from word a to before b."""
    short = F.least(F.col("size"), F.lit(2))
    lengths = ranked.select("item", "size").distinct()
    starts = postings.join(small(rarest(ranked, size)), "t").select("row", "item", (F.col("pos") - F.col("offset")).alias("start"))
    starts = starts.groupBy("row", "item", "start").agg(F.count("*").alias("n")).join(small(lengths), "item").where(F.col("n") >= short).select("row", "item", "start")
    own = postings.join(small(stored(starts, "starts")), "row").select("row", "item", "start", "t", (F.col("pos") - F.col("start")).alias("offset"))
    held = own.join(small(ranked.select("item", "offset", "t", "size")), ["item", "offset", "t"])
    nth = F.row_number().over(Window.partitionBy("row", "item", "start").orderBy("offset"))
    runs = held.withColumn("run", F.col("offset") - nth).groupBy("row", "item", "start", "size", "run").agg(F.min("offset").alias("a"), F.max("offset").alias("b"))
    long = F.col("b") - F.col("a") + 1 >= F.least(F.col("size"), F.lit(size))
    return runs.where(long).select("row", "item", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + 1).alias("b"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items (sorted ids), spans (merged hits: first word, end), contaminated."""
    own = distinct_items(items, item_col, item_text)
    rows, postings, named = index(docs, own.select(F.explode("terms").alias("term")), id_col, text_col)
    ranked = stored(ranked_terms(own, postings, named), "ranked")
    found = phrases(postings, ranked, size).join(small(own.select("item", "items")), "item")
    hits = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    one = rows.join(hits, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("spans", F.coalesce("spans", F.array().cast(hits.schema["spans"].dataType)))
    merge = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("hit")),
        lambda s, x: F.struct(F.greatest(s["to"], x["b"]).alias("to"), (s["hit"] + F.greatest(x["b"] - F.greatest(s["to"], x["a"]), F.lit(0))).alias("hit")),
    )
    return one.select(
        F.col("id").alias(id_col), "n_words", merge["hit"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"),
    )


def proximity(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = 0.8) -> DataFrame:
    """(row, id, item, matched, distance): rows in which at least ``share`` of an item's words, and two of them at least, stand at their offsets in the item, give or take ``slop`` words; of the starts with most words the least difference.

    A start is a place from which one word of the item at least stands at its very offset. A word's difference is that
    from the place which the start gives it, and the distance is the largest of a match. Words that the corpus lacks
    count as not found. Of n words that it has, a match holds two of the n - need + 2 rarest: only the starts within
    ``slop`` of where two of these put it are tried, and no match has another.
    """
    own = distinct_items(items, item_col, item_text)
    rows, postings, named = index(docs, own.select(F.explode("terms").alias("term")), id_col, text_col)
    terms = stored(ranked_terms(own, postings, named), "ranked")
    need = F.greatest(F.lit(2), F.ceil(F.col("size") * share).cast("int"))
    by = F.array_sort(F.collect_list(F.struct("n", "offset", "t"))).alias("by")
    ranked = stored(terms.groupBy("item", "size").agg(by).withColumn("need", need).where(F.size("by") >= F.col("need")), "needs")
    # Words that the corpus lacks can't be found: the other words are fewer, and so are the starts.
    rare = ranked.select("item", F.explode(F.slice("by", F.lit(1), F.size("by") - F.col("need") + 2)).alias("b")).select("item", "b.t", "b.offset")
    at = F.col("pos") - F.col("offset")
    starts = postings.join(small(rare), "t").select("row", "item", "offset", F.explode(F.sequence(at - slop, at + slop)).alias("start"))
    starts = starts.groupBy("row", "item", "start").agg((F.min("offset") < F.max("offset")).alias("two")).where("two")
    asked = stored(starts.join(small(ranked), "item").select("row", "item", "start", "need", F.explode("by").alias("x")).select("row", "item", "start", "need", "x.t", "x.offset"), "asked")
    near = postings.join(asked, ["row", "t"]).withColumn("gap", F.abs(F.col("pos") - F.col("start") - F.col("offset"))).where(F.col("gap") <= slop)
    gaps = near.groupBy("row", "item", "start", "need", "offset").agg(F.min("gap").alias("gap"))
    good = gaps.groupBy("row", "item", "start", "need").agg(F.count("*").alias("matched"), F.max("gap").alias("distance"), F.min("gap").alias("least")).where("matched >= need and least = 0")
    best = good.join(small(own.select("item", "items")), "item").select("row", F.explode("items").alias("item"), "matched", "distance")
    most = best.groupBy("row", "item").agg(F.min(F.struct((-F.col("matched")).alias("m"), F.col("distance").cast("int").alias("distance"))).alias("x"))
    return most.join(rows, "row").select("row", F.col("id").alias(id_col), "item", (-F.col("x.m")).cast("int").alias("matched"), F.col("x.distance").alias("distance"))
