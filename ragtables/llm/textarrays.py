"""Numpy views of Arrow text columns: word boundaries, substring hashes and ragged helpers.

All functions work on whole texts, block by block: a block holds whole documents of about ``BLOCK`` bytes (one
longer document makes a block of its own), so memory is bounded by the block, not by the Arrow batch.

Hashes are 64-bit: bytes mapped through a fixed random table, a polynomial prefix hash modulo 2**64, then a mixer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BLOCK = 1 << 20
BATCH_ROWS = 1000
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
TABLE = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=U64)
#: ASCII white space, the separators of words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offs):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last document + 1, bytes, local offsets) of runs of whole documents."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def owners(offs: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Document of each byte position."""
    return np.searchsorted(offs, positions, side="right") - 1


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside``; a run never crosses a document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without ASCII white space."""
    return runs(~SPACE[data], offs)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up = np.full(size, BASE, dtype=U64)
    down = np.full(size, inverse, dtype=U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse; sizes are rounded up, so that few are kept."""
    size = 1 << max(20, int(n).bit_length())
    return _powers(size)


class Substrings:
    """Hashes of any byte ranges of a block."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(TABLE[data] * up[: len(data)], dtype=U64, out=self.prefix[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial values: sum of TABLE[byte] * BASE**i, i from 0 in each range."""
        return (self.prefix[ends] - self.prefix[starts]) * self.down[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(U64))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    factor = 1
    for i in range(size):
        factor = factor * BASE % (1 << 64)
        total += values[i : i + n] * U64(factor)
    return mix(total)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index within the row) of counts[0] + counts[1] + ... items."""
    rows = np.repeat(np.arange(len(counts)), counts)
    firsts = np.cumsum(counts) - counts
    return rows, np.arange(len(rows)) - firsts[rows]


def per_document(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bounds in ``starts`` of each document: those of document d are bounds[d] to bounds[d + 1]."""
    return np.searchsorted(starts, offs)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (integers) between consecutive bounds."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def row_slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, so that work arrays stay small."""
    _, offs = text_buffers(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on: texts are long, and Spark bounds batches by rows only."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: str) -> DataFrame:
    """``fn`` over slices of bounded size of each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, text):
                yield fn(part)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length as one byte string, column by column."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blobs: list[bytes], dtypes: list[np.dtype]) -> list[np.ndarray]:
    """Columns of packed byte strings, one after the other."""
    width = sum(d.itemsize for d in dtypes)
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for part, d in zip(parts, dtypes, strict=True):
            part.append(np.frombuffer(blob, dtype=d, count=n, offset=at))
            at += n * d.itemsize
    return [np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, dtypes, strict=True)]


def buckets_of(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) of each bucket that has rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(sorted_[lo]), order[lo:hi]
