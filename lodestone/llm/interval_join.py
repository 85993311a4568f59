"""Overlap join of two sets of intervals by a relational interval tree, and its use on sales and click sessions.

The tree is virtual: positions 1 to 2^h - 1 are its nodes in order, and a node's level is the number of its trailing
zeros. An interval of the right side is stored at its fork, the highest node within it. An interval of the left side
meets

* those with a fork before it only at ancestors of its start, and there only intervals that end at its start or later;
* those with a fork after it only at ancestors of its end, and there only intervals that start at its end or before;
* all those with a fork inside it. The inside is cut into at most 2 h dyadic blocks, and each stored interval is listed
  under the h blocks that hold its fork, so that a long range is few probes.

A fork is before, inside or after, and inside in just one block: no pair is found twice, and every probe is an
equi-join of (group, node). Equal intervals of a group are one row with sums before the join (both sides compare
only slots), so a group with a third of all rows brings as many rows as it has distinct intervals, which time bounds
and not the number of rows; skewed joins are split by adaptive execution. Only the first and the last slot of all
reach the driver.

Sessions need no window over clicks: clicks of a client in one piece of ``GAP`` are in one session, so they are first
summed up by piece; the window then has at most a row for each piece of time.

Edge cases: rows with a null client, ``ts`` or ``sold_at`` take no part; a null kind is no error, a null status not
open; lines with a null sale or date change nothing; a sale without lines ends when it starts, as does one whose lines
were shipped before; each row of ``sales`` is a sale, also where ids repeat or are null; repeated clicks change nothing;
empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

#: Microseconds: the longest pause within a session, and a slot.
GAP, SLOT = 15 * 60 * 1_000_000, 6 * 3600 * 1_000_000
#: The end of an open interval.
NEVER = 2**62
#: By the starts (the left one earlier, equally, later), then by the ends.
RELATIONS = (("overlaps", "finished_by", "contains"), ("starts", "equals", "started_by"), ("during", "finishes", "overlapped_by"))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column, in whatever zone the session is; one without a zone counts as UTC."""
    t = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(t)
    seconds = F.unix_date(F.to_date(t)) * F.lit(86_400).cast("long") + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def floor_div(x: Column, by: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))


def sessions(clicks: DataFrame, client: str = "client_id", ts: str = "ts", kind: str = "kind", gap: int = GAP) -> DataFrame:
    """(client, first, last, open) of each session, times in microseconds; open if a click at its last time is an error."""
    own = clicks.select(F.col(client).alias("client"), micros(clicks, ts).alias("us"), F.coalesce(F.col(kind) == "error", F.lit(False)).alias("error"))
    own = own.where("client is not null and us is not null")
    pieces = own.groupBy("client", floor_div(F.col("us"), gap).alias("piece")).agg(F.min("us").alias("first"), F.max(F.struct("us", "error")).alias("last"))
    order = Window.partitionBy("client").orderBy("piece")
    begins = F.coalesce(F.col("first") - F.lag("last.us").over(order) > gap, F.lit(True))
    numbered = pieces.withColumn("begins", begins.cast("long")).withColumn("session", F.sum("begins").over(order))
    whole = numbered.groupBy("client", "session").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.select("client", "first", F.col("last.us").alias("last"), F.col("last.error").alias("open"))


def sale_times(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, client, first, last, open) of each row of ``sales`` that has a client and a time."""
    own = sales.select("sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    own = own.where("client is not null and first is not null")
    shipped = lines.select(F.col("sale_id").alias("of"), micros(lines, "shipped_at").alias("us")).where("of is not null and us is not null")
    shipped = shipped.groupBy("of").agg(F.max("us").alias("us"))
    joined = own.join(shipped, own["sale_id"] == shipped["of"], "left")
    return joined.select("sale_id", "client", "first", F.greatest("first", F.coalesce("us", "first")).alias("last"), "open")


def slots(df: DataFrame, *more: str) -> DataFrame:
    """(client, s, e and more): the slots of first and last; an open end is ``NEVER``."""
    return df.select("client", floor_div(F.col("first"), SLOT).alias("s"), F.when(F.col("open"), F.lit(NEVER)).otherwise(floor_div(F.col("last"), SLOT)).alias("e"), *more)


def _placed(df: DataFrame, low: int, height: int) -> DataFrame:
    """With l and u: the positions of s and e in the tree; an open end is the last position."""
    top = (1 << height) - 1
    return df.withColumn("l", F.col("s") - low + 1).withColumn("u", F.when(F.col("e") == NEVER, F.lit(top)).otherwise(F.col("e") - low + 1))


def _stored_nodes(height: int) -> Column:
    """The fork of l to u, and the blocks above it. Blocks are numbered from 1 at the top, forks lie beyond them."""
    fork = "shiftleft(shiftright(u, length(bin((l - 1) ^ u)) - 1), length(bin((l - 1) ^ u)) - 1)"
    blocks = f"transform(sequence(0, {height - 1}), k -> shiftleft(1L, {height} - k) + shiftright({fork}, k))"
    return F.expr(f"concat(array({fork} + shiftleft(2L, {height})), {blocks})")


def _probes(height: int) -> Column:
    """The ancestors of l before it, those of u after it, and the blocks that make up l to u."""
    levels, beyond = f"sequence(0, {height - 1})", f"shiftleft(2L, {height})"
    rest = lambda x: f"({x} & (shiftleft(1L, k) - 1)) <> 0"
    before = f"transform(filter({levels}, k -> (shiftright(l, k) & 1) = 1 and {rest('l')}), k -> shiftleft(shiftright(l, k), k) + {beyond})"
    after = f"transform(filter({levels}, k -> (shiftright(u, k) & 1) = 0 and {rest('u')}), k -> shiftleft(shiftright(u, k) + 1, k) + {beyond})"
    a, c = "shiftright(l + shiftleft(1L, k) - 1, k)", "shiftright(u + 1, k)"
    left = f"transform(filter({levels}, k -> {a} < {c} and {a} % 2 = 1), k -> shiftleft(1L, {height} - k) + {a})"
    right = f"transform(filter({levels}, k -> {a} < {c} and {c} % 2 = 1), k -> shiftleft(1L, {height} - k) + {c} - 1)"
    return F.expr(f"concat({before}, {after}, {left}, {right})")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """All columns of both sides for each pair with an equal client and a slot in common.

    Both have (client, s, e) with s <= e; the other columns of the right side must have names of their own. For least
    work, rows of a side with equal (client, s, e) should be one.
    """
    ends = left.select("s", "e").union(right.select("s", "e")).agg(F.min("s"), F.greatest(F.max("s"), F.max(F.when(F.col("e") < NEVER, F.col("e"))))).first()
    low, high = (ends[0], ends[1]) if ends[0] is not None else (0, 0)
    height = (high - low + 2).bit_length()
    at = _placed(right.withColumnsRenamed({"client": "of", "s": "s2", "e": "e2"}).withColumns({"s": F.col("s2"), "e": F.col("e2")}), low, height)
    at = at.select(F.explode(_stored_nodes(height)).alias("node2"), *(c for c in at.columns if c not in ("s", "e", "l", "u")))
    asked = _placed(left, low, height).withColumn("node", F.explode(_probes(height))).drop("l", "u")
    meets = (F.col("client") == F.col("of")) & (F.col("node") == F.col("node2")) & (F.col("e2") >= F.col("s")) & (F.col("s2") <= F.col("e"))
    return asked.join(at, meets).drop("node", "node2", "of")


def relation() -> Column:
    """The name of how s to e lies to s2 to e2."""
    by_end = lambda names: F.when(F.col("e") < F.col("e2"), names[0]).when(F.col("e") == F.col("e2"), names[1]).otherwise(names[2])
    earlier, equally, later = map(by_end, RELATIONS)
    return F.when(F.col("s") < F.col("s2"), earlier).when(F.col("s") == F.col("s2"), equally).otherwise(later)


def join(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) of each sale and relation that some session of its client has to it."""
    crc = F.crc32(F.col("first").cast("string").cast("binary"))
    seen = slots(sessions(clicks), crc.alias("crc")).groupBy("client", "s", "e").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    seen = stored(seen, "sessions")
    own = stored(slots(sale_times(sales, lines), "sale_id"), "sales")
    pairs = overlapping(own.select("client", "s", "e").distinct(), seen)
    shared = F.least("e", "e2") - F.greatest("s", "s2") + 1
    both_open = (F.col("e") == NEVER) & (F.col("e2") == NEVER)
    cells = pairs.groupBy("client", "s", "e", relation().alias("relation")).agg(
        F.sum("n").alias("n_pairs"), F.sum(F.when(~both_open, shared * F.col("n"))).alias("overlap_slots"), F.sum("crc").alias("sessions_crc")
    )
    return own.join(cells, ["client", "s", "e"]).select("sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc")
