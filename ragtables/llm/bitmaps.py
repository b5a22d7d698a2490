"""Bit maps of keys: rows that cannot match are dropped before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm import textarrays as ta

#: Bits of a key, and the size of the largest map (1 << MOST_BITS bits are 16 MB); a full map only drops fewer rows.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 16, 27


class BitMap:
    """Two bits for each 64-bit hash."""

    def __init__(self, bits: int, index: np.ndarray, mask: np.ndarray):
        self.bits, self.words = bits, np.zeros((1 << bits) >> 6, dtype=ta.U64)
        self.words[index] = mask.view(ta.U64)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for shift in (0, 32):
            at = (h >> ta.U64(shift)) & ta.U64((1 << self.bits) - 1)
            found &= (self.words[(at >> ta.U64(6)).astype(np.int64)] >> (at & ta.U64(63))) & ta.U64(1) == 1
        return found


def bit_map(keys: DataFrame) -> BitMap:
    """The map of a table with one long column, sized by its rows."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_KEY * keys.count()).bit_length()))
    h = keys.select(F.xxhash64(keys.columns[0]).alias("h"))
    low = F.lit((1 << bits) - 1).cast("long")
    at = h.select(F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask")).toArrow()
    return BitMap(bits, words.column("i").to_numpy(), words.column("mask").to_numpy())


def split(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose long ``column`` may be among ``keys``, rows whose column is not)."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(keys))
    names = rows.columns

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(len(names)).to_numpy().view(ta.U64)
                yield batch.select(names).filter(pa.array(shared.value.may_have(h) == wanted))

        return rows.withColumn("_hash", F.xxhash64(column)).mapInArrow(run, rows.schema)

    ta.bounded_batches(rows.sparkSession)
    return part(True), part(False)
