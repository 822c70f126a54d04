"""Shared helpers: table readers, checkpoints, and vectorised hashing over UTF-8 buffers."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.session import ship

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
#: A random 64-bit value for each byte, the digits of the polynomial hashes.
DIGITS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: `[^\x20\x09-\x0D]+` is a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that the session names; it must be one that all executors share."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", "")
        if not where:  # tests only: a cluster names its shared folder
            if not re.match(r"local(\[[^\],]*(,[^\]]*)?\])?$", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="fernquery-checkpoint-")
        context.setCheckpointDir(where)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """df written once as compressed Parquet in the shared folder and read again: it cuts the lineage like `cut` in a fraction of the space."""
    path = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, after which the worker gives freed memory back to the system: a worker serves many tasks, and its peaks would otherwise add up."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimming(run):
    """run, after whose batches the worker gives memory back: its own arrays are gone by then."""
    return lambda batches: trimmed(run(batches))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain), on whole arrays."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), wrapping at 64 bits, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = U64(pow(int(base), done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


class RangeHash:
    """Hashes of arbitrary byte ranges of one buffer, from wrapping prefix sums of digit * base ** i."""

    _up = powers(_BASE, 1)
    _down = powers(_BASE_INV, 1)

    def __init__(self, data: np.ndarray, fold: bool = False):
        n = len(data) + 1
        if len(RangeHash._up) < n:
            RangeHash._up, RangeHash._down = powers(_BASE, n + n // 4), powers(_BASE_INV, n + n // 4)
        digits = DIGITS[LOWER] if fold else DIGITS
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(digits[data] * RangeHash._up[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * RangeHash._down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per row) of the words of each row; a word never crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, at))


def slices(rows: int, at: np.ndarray, most: int = 1 << 21, each: int | None = None) -> list[tuple[int, int]]:
    """Cut rows into runs of at most `most` bytes (a longer row stands alone) and `each` rows, to bound the arrays."""
    out, low = [], 0
    while low < rows:
        high = int(np.searchsorted(at, at[low] + most, side="right")) - 1
        high = min(rows, max(high, low + 1), low + (each or rows))
        out.append((low, high))
        low = high
    return out


def runs_of(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most `most` bytes of text in `column`, to bound the arrays."""
    for b in batches:
        _, at = utf8(b.column(column))
        for lo, hi in slices(b.num_rows, at, most):
            yield b.slice(lo, hi - lo)


def crc_of_id(name: str = "doc_id"):
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
