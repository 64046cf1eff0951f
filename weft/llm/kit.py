"""What the operators share: Arrow text slices, byte-level words, rolling hashes, scratch tables.

Texts are read straight from Arrow's buffers as UTF-8 bytes, in slices of bounded size, so the
memory of a worker follows the longest single text and not the batch.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

np.seterr(over="ignore")  # hashes are sums and products modulo 2**64

SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))

# The five bytes 9-13 and the blank separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(df_dir: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{df_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
BYTE_CODE_LOWER = BYTE_CODE[LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for i, b in enumerate((BASE, BASE_INV)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                _pow[i] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """C with C[i] = sum over j < i of codes[j] * BASE**j, modulo 2**64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of bytes."""
    return prefix_sums((BYTE_CODE_LOWER if lower else BYTE_CODE)[data])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, wherever it stands."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


class Slice:
    """Some rows of a batch: the bytes of their texts end to end, and where each begins."""

    def __init__(self, batch: pa.RecordBatch, column: str):
        self.batch = batch
        array = batch.column(column)
        if not pa.types.is_large_string(array.type) and not pa.types.is_string(array.type):
            array = array.cast(pa.string())
        if array.null_count:
            array = array.fill_null("")
        wide = np.int64 if pa.types.is_large_string(array.type) else np.int32
        _, offsets, data = array.buffers()
        self.offsets = np.zeros(1, np.int64) if not len(array) else np.frombuffer(offsets, wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        self.offsets = self.offsets - first
        self.n = len(array)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and, by row, where its words begin among them."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        word = ~IS_SPACE[self.data]
        edge = np.zeros(len(word) + 1, bool)  # a word also begins where a text begins
        edge[self.offsets[:-1][self.offsets[:-1] < len(word)]] = True
        before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
        starts = np.flatnonzero(word & ~before)
        after = np.concatenate((word[1:], [False])) & ~edge[1:]
        ends = np.flatnonzero(word & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not every C library has it
    _trim = None


def settle() -> None:
    """Hands memory that a task no longer needs back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.string())), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield Slice(batch.slice(at, end - at), column)
            at = end
    settle()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row; len(words) - k + 1 of them, across all texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * BASE + words[j : j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class Scratch:
    """Intermediate tables, written as Parquet to the folder all executors share.

    A lost executor then costs the tasks it ran, not the lineage. `drop` removes a table that
    nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"/tmp/checkpoints/{os.getuid()}"
        self.base = f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        # shuffle files go when the plans that made them are garbage; the scheduler holds on to the last one until another has run
        gc.collect()
        self.spark.range(0, 1, 1, 1).collect()
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            if path := self.paths.pop(id(df), None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
