"""Tables in the folder that all executors see: intermediate results and the stored search index."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import library as L


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def state_of(df: DataFrame) -> str:
    """A digest of the files that a table is read from: their names, lengths and times. Empty if it isn't read from files."""
    jvm, conf, out = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        s = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest() if out else ""


def code_of(*modules) -> str:
    """A digest of the source of some modules."""
    return hashlib.sha256(b"".join(Path(m.__file__).read_bytes() for m in modules)).hexdigest()


class Kept(Mapping):
    """Stored tables by name: one that isn't stored under its manifest is made and stored when it is first asked for."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict[str, str], parts: dict):
        self.spark, self.path, self.manifest, self.parts, self.own = spark, path, manifest, parts, {}

    def __contains__(self, name) -> bool:
        return name in self.parts

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.own:
            mark = f"{self.path}/_made/{name}"
            if not L.same_manifest(self.spark, mark, self.manifest):
                self.parts[name](self).write.mode("overwrite").parquet(f"{self.path}/{name}")
                L.write_manifest(self.spark, mark, self.manifest)
            self.own[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self.own[name]

    def __iter__(self):
        return iter(self.parts)

    def __len__(self) -> int:
        return len(self.parts)


def kept(spark: SparkSession, name: str, manifest: dict[str, str], parts: dict) -> Kept:
    """Tables that are built once, when first asked for, and read again while their manifest is the same; otherwise they are built anew.

    ``parts`` has, by name, functions of the other tables. A table's manifest is written after it, so one that was left
    half-way is never read.
    """
    key = hashlib.sha256(repr(sorted(manifest.items())).encode()).hexdigest()[:24]
    return Kept(spark, f"{folder(spark)}/{name}-{key}", manifest, parts)


def drop(spark: SparkSession, name: str, manifest: dict[str, str]) -> None:
    """Delete a stored index."""
    key = hashlib.sha256(repr(sorted(manifest.items())).encode()).hexdigest()[:24]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{name}-{key}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the folder and read again: a cut in the lineage that outlives executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
