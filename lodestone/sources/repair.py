"""A library of document records as JSON lines: tolerant loading, and repair of what is stale in them.

A line that is no record, lacks what a record needs, or has passages of unknown shape becomes a row with a warning and
nothing else; all other lines are loaded. Term counts, lengths and vectors are made anew where their number isn't that
of the passages, unknown chunk types and outdated document types are set. All is done in a record's own row, so loading
needs no shuffle, and a record that was repaired is not repaired again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import text as X
from lodestone.operators import pages as P
from lodestone.operators import retrieval as R
from lodestone.sources.versions import Log

# The fields of a stored document and passage, and those that each must have.
PASSAGE = "doc_id:string,source_path:string,page:int,chunk_id:int,text:string,is_table_or_figure:boolean,raw_text:string,summary:string,noise_level:double,metrics:array<map<string,string>>,chunk_type:string,doc_type:string,short_tokens:array<string>"
RECORD = f"doc_id string, source_path string, ext string, title string, doc_type string, passages array<struct<{PASSAGE}>>, vectors array<map<string,double>>, term_counts array<map<string,bigint>>, doc_lengths array<bigint>"
NEEDED, PASSAGE_NEEDED = ["doc_id", "source_path", "ext", "passages"], ["doc_id", "source_path", "page", "chunk_id", "text"]

#: Lines of a stored file.
MOST_LINES = 1 << 14


def _counts(text: Column) -> Column:
    return F.map_from_entries(R.counted(X.tokenize(F.coalesce(text, F.lit("")))))


def parse(lines: DataFrame) -> DataFrame:
    """The fields of each line's record and ``warning``, null where it is sound. ``lines``: (value) and any others."""
    own = [c for c in lines.columns if c != "value"]
    schema = RECORD + ", _corrupt string"
    # Parsed once: what is read isn't parsed again for each field, nor where a filter is moved down.
    said = lines.withColumn("r", F.explode(F.array(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))))
    raw = F.from_json("value", "passages array<string>")["passages"]
    keys = F.transform(raw, lambda p: F.coalesce(F.json_object_keys(p), F.array().cast("array<string>")))
    known = F.array(*(F.lit(f.split(":")[0]) for f in PASSAGE.split(",")))
    needed = F.array(*map(F.lit, PASSAGE_NEEDED))
    missing = F.array_compact(F.array(*(F.when(F.col(f"r.{c}").isNull(), c) for c in NEEDED)))

    def shape(keys: Column) -> Column:
        odd = F.array_distinct(F.flatten(F.transform(keys, lambda k: F.array_except(k, known))))
        absent = F.array_distinct(F.flatten(F.transform(keys, lambda k: F.array_except(needed, k))))
        named = lambda words, names: X.bound(names, lambda n: F.when(F.size(n) > 0, F.concat(F.lit(words), F.array_join(F.array_sort(n), ", "))))
        return F.coalesce(named("unknown passage fields: ", odd), named("missing passage fields: ", absent))

    warning = (
        F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), F.lit("not a document record"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .otherwise(X.bound(keys, shape))
    )
    fields = [f.split(" ")[0] for f in RECORD.split(", ")]
    return said.withColumn("warning", warning).select(*own, *(F.when(F.col("warning").isNull(), F.col(f"r.{f}")).alias(f) for f in fields), "warning")


def repaired(records: DataFrame) -> DataFrame:
    """Records with stale fields made anew, and ``repairs``: the names of what was. Rows with a warning have neither."""
    n = F.size("passages")
    length = lambda c: F.coalesce(F.size(c), F.lit(-1))
    counts = (length("term_counts") != n) | (length("doc_lengths") != n)
    vectors = length("vectors") != n
    kind = lambda p: F.coalesce(p["chunk_type"], F.lit("unknown"))
    untyped = lambda p: kind(p).isin("", "unknown")
    typed = F.transform("passages", lambda p: p.withField("chunk_type", F.when(untyped(p), C.chunk_type(F.coalesce(p["text"], F.lit("")), F.coalesce(p["is_table_or_figure"], F.lit(False)), F.coalesce(p["noise_level"], F.lit(0.0)))).otherwise(p["chunk_type"])))
    name = F.when(F.coalesce("source_path", F.lit("")) != "", P.stem(F.col("source_path"))).otherwise(F.col("doc_id"))
    sample = F.transform(F.slice("passages", 1, 8), lambda p: F.coalesce(F.nullif(p["summary"], F.lit("")), p["text"], F.lit("")))
    blob = F.concat(F.lower(name), F.array_join(F.transform(F.filter(F.concat(F.array(F.coalesce("title", F.lit(""))), sample), lambda t: t != ""), lambda t: F.concat(F.lit(" \n"), F.lower(t))), ""))
    inferred, current = C.doc_type(name, blob), F.coalesce(F.nullif("doc_type", F.lit("")), F.lit("paper"))
    own = lambda p: F.coalesce(F.nullif(p["doc_type"], F.lit("")), F.col("current"))
    done = records.withColumns({"counts_": counts, "vectors_": vectors, "types_": F.exists("passages", untyped), "inferred": inferred, "current": current})
    done = done.withColumn("others_", F.exists("passages", lambda p: own(p) != F.col("inferred")))
    names = F.array_compact(F.array(F.when(F.col("counts_"), "term counts"), F.when(F.col("vectors_"), "vectors"), F.when(F.col("types_"), "chunk types"), F.when((F.col("inferred") != F.col("current")) | F.col("others_"), "document type")))
    done = done.withColumn("repairs", names).withColumn("made", F.when(F.col("counts_") | F.col("vectors_"), F.transform("passages", lambda p: _counts(p["text"]))))
    done = done.withColumn("passages", typed).withColumn("passages", F.transform("passages", lambda p: p.withField("doc_type", F.col("inferred"))))
    done = done.withColumn("term_counts", F.when(F.col("counts_"), F.col("made")).otherwise(F.col("term_counts")))
    done = done.withColumn("doc_lengths", F.when(F.col("counts_"), F.transform("made", lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x))).otherwise(F.col("doc_lengths")))
    done = done.withColumn("vectors", F.when(F.col("vectors_"), F.transform("made", lambda m: F.transform_values(m, lambda _, v: v.cast("double")))).otherwise(F.col("vectors")))
    done = done.withColumn("doc_type", F.col("inferred")).drop("counts_", "vectors_", "types_", "others_", "inferred", "current", "made")
    sound = F.col("warning").isNull()
    return done.withColumns({c: F.when(sound, F.col(c)) for c in ("passages", "term_counts", "doc_lengths", "vectors", "doc_type", "repairs")})


def _line() -> Column:
    """A record as a JSON line; fields without a value are written as null, so that a passage keeps all it needs."""
    return F.to_json(F.struct(*(f.split(" ")[0] for f in RECORD.split(", "))), {"ignoreNullFields": "false"})


def to_lines(records: DataFrame) -> DataFrame:
    """(value): records as JSON lines."""
    return records.select(_line().alias("value"))


class LibraryStore:
    """Records in versions. ``repair`` commits one with repaired records if there are any; all other lines are kept as they are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)

    def save(self, lines: DataFrame) -> int:
        name = f"lines-{uuid.uuid4().hex}"
        # Compressed files are read whole by one task each, so none holds more than so many lines.
        lines.select("value").write.option("compression", "gzip").option("maxRecordsPerFile", MOST_LINES).text(f"{self.log.path}/{name}")
        return self.log.commit(self.log.latest()[0], {"lines": name})

    def load(self) -> DataFrame:
        """All lines: the fields of a record with ``repairs``, or ``warning``; and ``file`` and ``value``, the line as it is."""
        said = self.log.latest()[1]
        if "lines" not in said:
            lines = self.spark.createDataFrame([], "value string, file string")
        else:
            lines = self.spark.read.text(f"{self.log.path}/{said['lines']}").select("value", F.col("_metadata.file_name").alias("file"))
        return repaired(parse(lines.where(F.col("value").rlike(r"(?U)\S")).withColumn("line", F.col("value"))).withColumnRenamed("line", "value"))

    def repair(self) -> bool:
        """Whether a version with repaired records was committed; statistics made from older ones are then out of date."""
        all_ = self.load()
        # Any stale record will do. A plain filter would be moved below the repair, with all of it within.
        if all_.select(F.explode(F.array(F.size("repairs"))).alias("n")).where("n > 0").isEmpty():
            return False
        self.save(all_.select(F.when(F.size("repairs") > 0, _line()).otherwise(F.col("value")).alias("value")))
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Delete the lines and versions older than the newest ``keep``."""
        for n in self.log.numbers()[keep:]:
            if (said := self.log.read(n)) and said.get("lines"):
                self.log.remove(said["lines"])
            self.log.remove(f"_log/{n:012d}.json")
