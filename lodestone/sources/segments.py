"""A search index that grows by segments: new, changed and withdrawn documents cost what they hold, not what the index holds.

A segment has the passages and postings of the documents of one change, a line for each document, the change of each
term's document frequency, and the ids whose rows in earlier segments no longer count. Counts of documents, passages and
tokens are kept by version in the log, as sums and differences. No change reads an old text: documents that are replaced
or withdrawn lower the frequencies by their stored postings. ``compact`` writes all segments as one.

Document ids must be unique within a change and not null. A change without documents commits nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.sources.versions import Log

_SUMS = ("total_docs", "total_passages", "tokens", "worded")


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)
        self.path = self.log.path

    def version(self) -> int:
        return self.log.latest()[0]

    # ---- what a version holds

    def _live(self, part: str, segments: list[dict]) -> DataFrame | None:
        """Rows of a part whose documents no later segment has replaced or withdrawn."""
        out, gone = None, None
        for s in reversed(segments):
            if s["docs"]:
                rows = self.spark.read.parquet(f"{self.path}/{s['name']}/{part}")
                rows = rows if gone is None else rows.join(R.small(gone.distinct()), "doc_id", "left_anti")
                out = rows if out is None else out.unionByName(rows)
            if s["gone"]:
                own = self.spark.read.parquet(f"{self.path}/{s['name']}/gone")
                gone = own if gone is None else gone.union(own)
        return out

    def frequencies(self, segments: list[dict]) -> DataFrame:
        """(term, df): the sums of all changes."""
        paths = [f"{self.path}/{s['name']}/df" for s in segments]
        return self.spark.read.parquet(*paths).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def library(self, version: int | None = None) -> R.Library:
        """The index as it was committed by a version, the newest if none is named."""
        n, said = self.log.latest() if version is None else (version, self.log.read(version))
        segments = (said or {}).get("segments", [])
        if not any(s["docs"] for s in segments):
            raise LookupError(f"no documents in {self.path}")
        sums = said["sums"]
        row = (sums["total_docs"], sums["total_passages"], sums["tokens"] / sums["total_passages"] if sums["total_passages"] else 0.0, sums["worded"])
        tables = {"passages": self._live("passages", segments), "terms": self._live("terms", segments), "df": self.frequencies(segments)}
        tables["stats"] = self.spark.createDataFrame([row], "total_docs long, total_passages long, avg_length double, worded long")
        tables["idf"] = R.Library.PARTS["idf"](tables)
        tables["norms"] = self._norms(n, tables)
        return R.Library(tables["passages"], tables)

    def _norms(self, version: int, tables: dict) -> DataFrame:
        """Norms hang on all frequencies: they are made from stored postings for the first reader of a version that asks for them."""
        name = f"norms-{version}"
        if not self.log.exists(f"{name}/_SUCCESS"):
            return R.Library.PARTS["norms"](tables)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def settle(self) -> None:
        """Store the norms of the newest version, for many searches by cosine to come."""
        n = self.version()
        if not self.log.exists(f"norms-{n}/_SUCCESS"):
            self.library(n).norms.write.mode("overwrite").parquet(f"{self.path}/norms-{n}")

    # ---- changes

    def _change(self, docs: DataFrame | None, gone: DataFrame | None, mark: dict | None = None) -> int:
        after, said = self.log.latest()
        segments = said.get("segments", [])
        name = f"segment-{uuid.uuid4().hex}"
        part = lambda x: f"{self.path}/{name}/{x}"
        # A document without passages has a row with no passage, so that it replaces an older one.
        none = self.spark.createDataFrame([], "term string, df long")
        up = down = none
        more, less = dict.fromkeys(_SUMS, 0), dict.fromkeys(_SUMS, 0)
        if docs is not None:
            R.passages(docs).write.parquet(part("passages"))
            made = {"passages": self.spark.read.parquet(part("passages"))}
            made["counted"] = R.Library.PARTS["counted"](made)
            R.Library.PARTS["terms"](made).write.parquet(part("terms"))
            terms = self.spark.read.parquet(part("terms"))
            up = R.document_frequency(terms.where("term is not null"))
            self._lines(terms).write.parquet(part("docs"))
            more = self._sums(self.spark.read.parquet(part("docs")))
            if gone is None:
                gone = docs.select("doc_id").distinct()
        old = self._live("docs", segments)
        n_gone = 0
        if old is not None and gone is not None:
            old.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").write.parquet(part("gone_docs"))
            left = self.spark.read.parquet(part("gone_docs"))
            less = self._sums(left)
            n_gone = less["total_docs"]
        if not more["total_docs"] and not n_gone:
            self.log.remove(name)
            if mark:
                return self.log.commit(after, {"segments": segments, "sums": said.get("sums", more), "marks": said.get("marks", {}) | mark})
            return after
        if n_gone:
            left.select("doc_id").write.parquet(part("gone"))
            lost = self._live("terms", segments).where("term is not null").join(R.small(left.select("doc_id")), "doc_id", "left_semi")
            down = R.document_frequency(lost).select("term", (-F.col("df")).alias("df"))
        up.union(down).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(part("df"))
        was = said.get("sums", dict.fromkeys(_SUMS, 0))
        payload = {"segments": [*segments, {"name": name, "docs": more["total_docs"], "gone": n_gone}], "sums": {k: was[k] + more[k] - less[k] for k in _SUMS}, "marks": said.get("marks", {}) | (mark or {})}
        return self.log.commit(after, payload)

    @staticmethod
    def _lines(terms: DataFrame) -> DataFrame:
        """(doc_id, passages, tokens) of each document that has passages."""
        each = terms.groupBy("doc_id", "chunk_id").agg(F.first("length").alias("length"))
        return each.groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum("length").alias("tokens"))

    @staticmethod
    def _sums(lines: DataFrame) -> dict:
        zero = lambda c: F.coalesce(c, F.lit(0))
        return lines.agg(F.count("*").alias("total_docs"), zero(F.sum("passages")).alias("total_passages"), zero(F.sum("tokens")).alias("tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("worded")).first().asDict()

    def add(self, docs: DataFrame, mark: dict | None = None) -> int:
        """Add documents (doc_id, text); those whose ids are there already are replaced. The committed version."""
        return self._change(docs.select("doc_id", "text"), None, mark)

    def remove(self, doc_ids: DataFrame) -> int:
        return self._change(None, doc_ids)

    def compact(self) -> int:
        """All segments as one, without replaced rows; the old ones stay for readers of older versions until ``vacuum``."""
        after, said = self.log.latest()
        segments = said.get("segments", [])
        if len(segments) < 2:
            return after
        name = f"segment-{uuid.uuid4().hex}"
        for part in ("passages", "terms", "docs"):
            self._live(part, segments).write.parquet(f"{self.path}/{name}/{part}")
        self.frequencies(segments).write.parquet(f"{self.path}/{name}/df")
        return self.log.commit(after, said | {"segments": [{"name": name, "docs": said["sums"]["total_docs"], "gone": 0}]})

    def vacuum(self) -> None:
        """Delete the versions before the newest, and the segments and norms that it doesn't use."""
        n, said = self.log.latest()
        used = {s["name"] for s in said.get("segments", [])}
        for old in self.log.numbers():
            if old != n:
                for s in (self.log.read(old) or {}).get("segments", []):
                    if s["name"] not in used:
                        self.log.remove(s["name"])
                self.log.remove(f"norms-{old}")
                self.log.remove(f"_log/{old:012d}.json")
