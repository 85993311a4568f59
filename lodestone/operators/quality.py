"""The quality filter: per-row scores and gates as columns, then one fold per query over its few candidates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import text as X
from lodestone.functions import values as V


def scored(c: DataFrame, mode: str | None = None) -> DataFrame:
    """Adds noise, penalty, weights, overlaps, the adjusted score and the reason of the gate that drops a row (null: none).

    ``c``: query_id, pos, score, terms, targets, doc_id, chunk_id, text, summary, chunk_type, doc_type,
    is_table_or_figure, noise_level, has_metrics, runtime_signal.
    """
    col = F.col
    searchable = F.lower(F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    figure, target = C.is_figure_chunk(col("chunk_type"), col("is_table_or_figure")), F.array_contains("targets", col("doc_id"))
    c = c.withColumn("target", F.coalesce(target, F.lit(False))).withColumn("figure", figure).withColumn("info", X.informative(F.col("terms"), mode))
    noise = C.effective_noise(col("text"), col("chunk_type"), col("is_table_or_figure"), col("noise_level"))
    c = c.withColumn("penalty", F.least(F.lit(0.85), noise * 0.8 + F.when(col("figure"), F.when(col("has_metrics"), 0.15).otherwise(0.25)).otherwise(0.0)))
    prefer = F.exists("seen", lambda d: F.array_contains(F.col("targets"), d))
    seen = c.groupBy("query_id").agg(F.collect_set("doc_id").alias("seen"))  # documents of a query's few candidates
    c = c.join(seen, "query_id").withColumn("prefer", F.coalesce(prefer, F.lit(False))).drop("seen")
    weight = C.mode_weight(searchable, col("doc_type"), mode)
    pulled = F.greatest(F.lit(0.4), F.least(F.lit(1.8), weight * F.when(col("target"), 1.25).otherwise(0.65)))
    c = c.withColumn("weight", F.when(col("prefer"), pulled).otherwise(weight))
    c = c.withColumn("overlap", X.overlap(col("terms"), searchable)).withColumn("info_overlap", X.overlap(col("info"), searchable))
    asked = F.coalesce(F.size("terms"), F.lit(0)) > 0
    q = F.when(~asked, 1.0).when(col("overlap") == 0, 0.1).otherwise(0.4 + 0.6 * col("overlap"))
    c = c.withColumn("query_weight", q).withColumn("adjusted", col("score") * col("weight") * (1 - col("penalty")) * q)
    intent = F.coalesce(X.metric_intent(col("terms")), F.lit(False))
    scoped = F.lit(mode == "paper") & intent & (F.coalesce(F.size("targets"), F.lit(0)) > 0)
    some = F.size("info") > 0
    signal = scoped & col("target") & col("figure") & ~col("has_metrics") & (col("overlap") >= 0.3) & (col("penalty") <= 0.4) & (~some | (col("info_overlap") >= 0.2)) & col("runtime_signal")
    c = c.withColumn("intent", intent).withColumn("signal", signal).withColumn("metric", col("has_metrics") | signal)
    strong = some & (col("info_overlap") >= 0.6)
    bare = col("figure") & ~col("has_metrics") & ~signal & ~(col("target") & (strong | (col("overlap") >= 0.6)))
    anchored = scoped & col("target") & (col("overlap") >= 0.3) & (col("penalty") <= 0.4) & (col("info_overlap") >= 0.15)
    off = col("figure") & col("has_metrics") & ~(strong | C.mode_context(col("doc_type"), mode) | anchored)
    anchor = col("target") & asked & (col("overlap") >= 0.3) & (col("penalty") <= 0.4)
    blank = some & (col("info_overlap") == 0) & ~anchor & ~(col("intent") & col("metric") & (col("overlap") > 0))
    reason = F.when(bare, V.REASONS["bare figure"]).when(off, V.REASONS["off figure"]).when(blank, V.REASONS["uninformative"]).when(asked & (col("overlap") == 0), V.REASONS["no overlap"])
    return c.withColumn("gate", reason).withColumn("anchor", asked & (col("overlap") >= 0.3) & (col("penalty") <= 0.4))


_FACTS = "query_id", "pos", "adjusted", "doc_id", "chunk_id", "print", "figure", "metric", "has_metrics", "target", "anchor", "info_overlap", "overlap", "penalty", "gate", "intent", "scoped"


def _better_target(x: dict, weakest: float) -> bool:
    named = x["anchor"] or x["info_overlap"] >= 0.2 or (x["intent"] and x["has_metrics"])
    return x["target"] and named and x["adjusted"] + 0.05 >= weakest


def fold(rows: list[dict], k: int) -> list[tuple]:
    """(place, final rank or None, reason) of one query's candidates, which come with their facts.

    What is kept depends on what was kept before: duplicates, quotas and the three rescues are no windows.
    """
    why = {x["pos"]: x["gate"] for x in rows}
    line = sorted((x for x in rows if x["gate"] is None), key=lambda x: (-x["adjusted"], x["pos"]))
    kept: list[dict] = []
    most = max(2, k // 2)
    for x in line:
        if len(kept) == k:
            break
        own = [y for y in kept if y["doc_id"] == x["doc_id"]]
        if any(y["print"] == x["print"] for y in kept):
            why[x["pos"]] = V.REASONS["duplicate"]
        elif len(own) >= most:
            why[x["pos"]] = V.REASONS["document"]
        elif x["figure"] and not x["metric"] and any(y["figure"] for y in own):
            why[x["pos"]] = V.REASONS["figure"]
        else:
            kept.append(x)

    def rescue(fits, at: int | None, reason: str) -> None:
        hero = next((x for x in line if x not in kept and fits(x)), None)
        if hero is None:
            return
        if at is None:
            kept.append(hero)
        else:
            why[kept[at]["pos"]] = f"{V.REASONS['replaced']} {hero['doc_id']}:{hero['chunk_id']}"
            kept[at] = hero
        why[hero["pos"]] = V.REASONS[reason]

    scoped, intent = any(x["scoped"] for x in rows), any(x["intent"] for x in rows)
    if scoped and kept and not any(x["target"] for x in kept):  # the weakest makes room for a qualified one
        weakest = min(range(len(kept)), key=lambda i: kept[i]["adjusted"])
        rescue(lambda x: _better_target(x, kept[weakest]["adjusted"]), weakest, "target rescue")
    if scoped and not kept:
        rescue(lambda x: x["target"] and x["penalty"] <= 0.55 and (not x["figure"] or x["has_metrics"]), None, "target rescue")
    if intent and kept and not any(x["metric"] for x in kept):  # the last makes room
        rescue(lambda x: x["metric"] and (x["overlap"] > 0 or x["info_overlap"] > 0), len(kept) - 1, "metric rescue")
    ranks = {x["pos"]: i for i, x in enumerate(kept, 1)}
    return [(x["pos"], ranks.get(x["pos"]), why[x["pos"]] or V.REASONS["kept" if x["pos"] in ranks else "below"]) for x in rows]


def decide(c: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, doc_id, chunk_id, final_rank, reason) of every scored candidate; the rank is null where it is dropped.

    Candidates are a small multiple of k for each query, so one group holds them; only their facts travel, no texts.
    """
    facts = c.withColumn("print", X.fingerprint(F.coalesce("text", "summary", F.lit("")))).withColumn("scoped", F.coalesce(F.size("targets"), F.lit(0)) > 0).select(*_FACTS)

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        said = fold(rows, k)
        order = {x["pos"]: i for i, x in enumerate(rows)}
        out = table.take(pa.array([order[p] for p, _, _ in said], pa.int64())).select(["query_id", "pos", "doc_id", "chunk_id"])
        return out.append_column("final_rank", pa.array([r for _, r, _ in said], pa.int32())).append_column("reason", pa.array([w for _, _, w in said], pa.string()))

    kind = ", ".join(f"{n} {facts.schema[n].dataType.simpleString()}" for n in ("query_id", "pos", "doc_id", "chunk_id"))
    return facts.groupBy("query_id").applyInArrow(one, f"{kind}, final_rank int, reason string")


def select(c: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, chunk_id, final_rank) of the rows that a query keeps of its scored candidates."""
    return decide(c, k).where("final_rank is not null").select("query_id", "doc_id", "chunk_id", "final_rank")
