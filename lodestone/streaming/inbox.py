"""The inbox folder as a file stream: new text files become passages, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import text as X
from lodestone.operators import retrieval as R
from lodestone.sources.segments import SearchIndex


def read_inbox(spark: SparkSession, inbox: str, archive: str | None = None) -> DataFrame:
    """(source_path, text) of arriving text and markdown files; with an archive, read files are moved there."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.{txt,md}").option("latestFirst", "true")
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.load(inbox).select(F.col("_metadata.file_path").alias("source_path"), X.clean_text(F.col("value")).alias("text"))


def sync(spark: SparkSession, inbox: str, out: str, checkpoint: str, archive: str | None = None) -> StreamingQuery:
    """Ingest what has arrived since the last call and end; a batch that runs again replaces its own folder."""

    def ingest(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.element_at(F.split("source_path", "/"), -1).alias("doc_id"), "text")
        R.annotate(R.passages(docs)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return read_inbox(spark, inbox, archive).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_index(spark: SparkSession, inbox: str, index: SearchIndex, checkpoint: str, archive: str | None = None) -> StreamingQuery:
    """Add what has arrived to a search index and end. The index remembers the last batch of a checkpoint, so one that runs again after a failure is not added twice."""

    def ingest(batch: DataFrame, number: int) -> None:
        if index.log.latest()[1].get("marks", {}).get(checkpoint, -1) < number:
            index.add(batch.select(F.element_at(F.split("source_path", "/"), -1).alias("doc_id"), "text"), mark={checkpoint: number})

    return read_inbox(spark, inbox, archive).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
