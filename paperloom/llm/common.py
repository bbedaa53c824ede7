"""Shared pieces of the training-data operators: scratch tables, text batches, word hashes.

Words everywhere are maximal runs of characters other than space and U+0009 to
U+000D. On UTF-8 bytes that is what ``bytes.split()`` cuts, so the kernels below
work on the Arrow string buffer and never build Python strings per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: The same word class for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a kernel holds at a time; one longer document is held alone.
CHUNK_BYTES = 1 << 20
#: A side of at most so many bytes of rows may be broadcast; beyond it a shuffle join is used.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables in the shared folder (``spark.checkpoint.dir``) that cut lineage.

    Where a local session names no folder (tests), one is made; on a cluster that is an error. The folder
    of a run goes when the JVM ends; ``drop`` removes a table that is no longer read.
    """

    def __init__(self, spark: SparkSession, tag: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = f"file://{tempfile.gettempdir()}/paperloom-scratch"
        self.spark, self.path = spark, f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        fs, p = self._fs(self.path)
        fs.deleteOnExit(p)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back. The shuffles that made it go once it is written: nothing reads them again."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                fs, p = self._fs(path)
                fs.delete(p, True)


def row_bytes(df: DataFrame) -> int:
    """Bytes that a stored table's rows are sure to stay below in memory, from its count and its columns' kinds; for tables of fixed-width columns."""
    return df.count() * (8 + 8 * len(df.columns))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a stored table of ids, numbers and short keys for broadcast after bounding its bytes; a larger one is left to the shuffle join."""
    wide = sum(isinstance(f.dataType, (StringType, BinaryType, ArrayType)) for f in df.schema)
    if wide:
        lengths = [F.sum(F.coalesce(F.length(f.name) * 4 if not isinstance(f.dataType, ArrayType) else F.size(f.name) * 8, F.lit(0))) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType))]
        n, *sums = df.agg(F.count(F.lit(1)), *lengths).first()
        size = n * (8 + 24 * len(df.columns)) + sum(x or 0 for x in sums)
    else:
        size = row_bytes(df)
    return F.broadcast(df) if size <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- text batches


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; null texts are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    nulls = np.asarray(column.is_null())
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), nulls
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0], nulls


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lean(run: Callable) -> Callable:
    """A batch kernel whose worker gives freed memory back when its task ends: workers live on, and without this each keeps
    the most that any task needed."""

    @functools.wraps(run)
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return kernel


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Mask of the first n bytes of a little-endian 64-bit chunk.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Longer words are hashed by the library, one by one.
_LONG_WORD = 512


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words and, per document, the index of its first word."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    begin, end = ~space, ~space
    cut = offsets[(offsets > 0) & (offsets < n)]
    keep = begin[cut], end[cut - 1]
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    begin[cut], end[cut - 1] = keep
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word, the same in every process. lower: A-Z count as a-z.

    A word goes through the finaliser in chunks of eight bytes, each step a bijection of the state, from a
    state that depends on its length; words of one length up to eight bytes never collide. (A polynomial of
    the bytes modulo 2^64 would collide on structured words whatever its base.)
    """
    size = ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * _GOLD)
    if not len(starts):
        return out
    if lower:
        raw = _LOWER[raw]
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    chunk = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (chunk[at] & _HEAD[np.minimum(left, 8)]))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest()
        out[i] ^= np.frombuffer(digest, "<u8")[0]
    return out


def fold(total: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step of a running hash of a sequence: bijective in either argument."""
    total = (total ^ h) * _STEP
    return total ^ (total >> np.uint64(29))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes (position i: h[i:i+k])."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for j in range(k):
        total = fold(total, h[j : j + n])
    return mix(total)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
