"""Ordered string aggregation that never gathers a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import _sorted_checkpoint, join_on_keys, needs_split


def ordered_join(df: DataFrame, keys: list[str], order_by: list[str], text_col: str, sep: str, out_col: str = "text",
                 max_key_rows: int | None = None) -> DataFrame:
    """Per ``keys``: the ``text_col`` values joined by ``sep`` in ``order_by`` order.

    Keys up to ``max_key_rows`` rows: one ordered collect per key. Larger keys: two levels -- rows are
    range-split on (keys, order) so the key spans several partitions; each (partition, key) joins its
    rows, then the key joins at most one piece per partition.
    """
    if not needs_split(df, keys, max_key_rows):
        order = F.struct(*[F.col(c) for c in order_by], F.col(text_col).alias("_t"))
        g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_r"))
        return g.select(*keys, F.array_join(F.transform("_r", lambda x: x["_t"]), sep).alias(out_col))
    keyed = _sorted_checkpoint(df.select(*keys, *[c for c in order_by if c not in keys], text_col), keys, order_by)
    pieces = keyed.groupBy("_pid", *keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_mid", F.col(text_col).alias("t")))), lambda x: x["t"]), sep).alias("_t")
    )
    return pieces.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pid", "_t"))), lambda x: x["_t"]), sep).alias(out_col)
    )


def ordered_parts(df: DataFrame, keys: list[str], order_by: list[str], text_col: str, sep: str, part_bytes: int, out_col: str = "text") -> DataFrame:
    """(keys, part, out_col): the text of ``ordered_join`` cut between values into parts of about ``part_bytes`` (a part
    ends with the value that reaches the next multiple), numbered in ascending order from 0.

    A part follows from the bytes before a value: sums per (partition, key) are added up over the partitions, and each
    partition adds up its own rows. No task holds more of a key than one partition or one part."""
    size = (F.octet_length(text_col) + len(sep.encode())).cast("long").alias("_bytes")
    sized = df.select(*keys, *[c for c in order_by if c not in keys], F.col(text_col).alias("_value"), size).filter("_value is not null")
    keyed = _sorted_checkpoint(sized, keys, order_by)
    sums = keyed.groupBy("_pid", *keys).agg(F.sum("_bytes").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select("_pid", *keys, "_off")
    own = Window.partitionBy("_pid", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_on_keys(keyed.withColumn("_own", F.coalesce(F.sum("_bytes").over(own), F.lit(0))), offsets, ["_pid"], keys)
    part = F.floor((F.col("_off") + F.col("_own")) / part_bytes).cast("int").alias("part")
    rows = F.array_sort(F.collect_list(F.struct("_mid", "_value")))
    return placed.groupBy(*keys, part).agg(F.array_join(F.transform(rows, lambda x: x["_value"]), sep).alias(out_col))
