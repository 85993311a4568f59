"""Shared helpers of the training-data operators: shipping, columns, hashed word scans."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()

#: Bytes that end a word for the operators that cut on white space.
WHITE = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ship(spark: SparkSession) -> None:
    """Let the executors import this package when the session's path doesn't hold it."""
    places = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    sc = spark.sparkContext
    if str(_ROOT) in places or os.path.realpath(os.getcwd()) == str(_ROOT) or sc.applicationId in _SHIPPED:
        return
    out = Path(tempfile.mkdtemp()) / "lodestone_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (_ROOT / "lodestone").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, from ``spark.checkpoint.dir``; where it is unset, a local one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``stored`` writes within are deleted at the end: what is lazily read from them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder, in folders of the values of ``by``, and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{tag}-{uuid.uuid4().hex}"
    out = df.write.option("parquet.block.size", 32 << 20)  # a writer's buffer
    (out.partitionBy(by) if by else out).parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``stored``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(conf).delete(p, True)


def tidied(f):
    """A function over Arrow batches that gives freed memory back to the system when its task ends: workers live on."""

    def run(batches):
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(df: DataFrame, n: int, index) -> DataFrame:
    """Rows with index i (0 to n - 1) go to partition i: a hash would put several heavy shards into one task."""
    return df.repartitionById(n, index.cast("int"))


def held(column: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest`` (nulls: of the empty string)."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % mod == rest


def drawn(rows: DataFrame, group: str, key: str, size: str, most: int, most_bytes: int, sums: list | None = None) -> DataFrame:
    """At most ``most`` rows of each value of ``group``, and about ``most_bytes`` of ``size``: those of the smallest hashes of ``key``.

    Hashes are first cut at a bound that leaves a few rows more than that, however many rows there are; only these are ranked.
    ``sums`` are (``group``, n, bytes) rows, where they are known.
    """
    sums = sums or rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
    bound = F.lit(None).cast("long")
    for r in sums:
        wanted = min(most, most_bytes * r["n"] / max(1, r["bytes"] or 0))
        share = min(1.0, (wanted + 4 * wanted**0.5 + 10) / r["n"])
        bound = F.when(F.col(group).eqNullSafe(F.lit(r[group])), F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).otherwise(bound)
    mark = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(2))
    order = Window.partitionBy(group).orderBy("_mark", key, size)
    near = rows.withColumn("_mark", mark).where(F.col("_mark") <= bound)
    ranked = near.withColumn("_rank", F.row_number().over(order)).withColumn("_sum", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.where((F.col("_rank") <= most) & (F.col("_sum") < most_bytes)).drop("_mark", "_rank", "_sum")


# ---------------------------------------------------------------- hashed words

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_KEY = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"n": 0}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if _powers["n"] < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers.update(n=m, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each span of a sequence of 64-bit symbol keys, independent of its place."""
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        run = np.empty(len(values) + 1, np.uint64)
        run[0] = 0
        np.cumsum(values * up[: len(values)], out=run[1:])
        raw = (run[ends] - run[starts]) * down[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(buf: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't in ``gap`` (a table of 256 booleans)."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~gap[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


_GAP = np.zeros(256, bool)
_GAP[list(WHITE)] = True


def scan_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts laid end to end with A-Z lower-cased, start, end and fingerprint of each word, number of words of each text). Words are cut at white space."""
    joined = b"\n".join(texts).translate(LOWER)
    buf = np.frombuffer(joined, np.uint8)
    starts, ends = word_spans(buf, _GAP)
    edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(starts, edges), prepend=0)
    return joined, starts, ends, span_hashes(_BYTE_KEY[buf], starts, ends), counts


def slices(sizes: list[int], most: int):
    """Consecutive ranges of rows whose sizes sum to about ``most`` (a larger row stands alone)."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(column, most: int):
    """(first row, end, slice of the column) of consecutive rows with about ``most`` bytes: Python objects are made for few texts at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes, most):
        yield a, b, column.slice(a, b - a)


class Ragged:
    """Growing lists of numbers, one after the other."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.at, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Append lists; their numbers."""
        self.flat = self._room(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at, self.length = self._room(self.at, self.n + len(sizes)), self._room(self.length, self.n + len(sizes))
        self.at[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.length[self.n : self.n + len(sizes)] = sizes
        names = np.arange(self.n, self.n + len(sizes))
        self.used, self.n = self.used + len(flat), self.n + len(sizes)
        return names


def ragged_take(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` that begin at ``at``, one after the other."""
    out = np.repeat(at - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return flat[out]


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(a: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(_ZSTD.decompress(b[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(dtype)
