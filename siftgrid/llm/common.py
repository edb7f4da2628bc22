"""Shared helpers: table access, Arrow blocks and a vectorised word scanner.

A *word* is a maximal run of bytes that are digits, ASCII letters (A-Z folded
to a-z) or part of a non-ASCII code point.  Because every byte of a non-ASCII
code point is >= 0x80, the byte-wise scan equals the code-point pattern
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on lower-cased text.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
IS_WORD[128:] = True

_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Tables under so many bytes per core, and of fewer files than cores, are dealt out to all cores.
SMALL_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one, often a single row group, is dealt out to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL_BYTES and len(rows.inputFiles()) < cores else rows


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder named in ``spark.checkpoint.dir``.

    A session in local mode that names none gets a temporary folder; on a
    cluster that would be another folder on every machine, so it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="siftgrid-checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; wraps modulo 2**64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the polynomial base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c[i] = polynomial hash of data[:i]; feed to :func:`span_hash`."""
    up, _ = _POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of each byte span, independent of its position."""
    _, down = _POWERS.upto(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts])


def hash_bytes(text: bytes) -> int:
    data = LOWER[np.frombuffer(text, dtype=np.uint8)]
    return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut rows into blocks of about ``size`` bytes (never inside a row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words of a block."""
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _trim() -> None:
    """Give freed memory back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to do


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes at most (views, no copies)."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), step):
            yield batch.slice(at, step)


def lean(function: Callable) -> Callable:
    """The same function of batches with a small footprint.

    It gets its input, and so gives its output, in small slices, and trims its
    worker's memory at the end of a task.
    """

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(slices(batches))
        _trim()

    return over_batches


def lean_group(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def over_group(table: pa.Table) -> pa.Table:
        out = function(table)
        _trim()
        return out

    return over_group


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that text operators read; further columns don't matter."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
