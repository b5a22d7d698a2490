"""Ordinals and ``lag`` without putting a whole key in one task.

Rows are range-partitioned and sorted on (key, order), so a hot key spans several partitions. The
sorted frame is checkpointed (into the cluster's ``spark.checkpoint.dir``) so every use sees the same
partition ids. Each partition numbers its rows locally (``monotonically_increasing_id`` is sequential
inside a partition); a small table with one row per (partition, key) -- bounded by keys + partitions --
gives per-key offsets and the rows that precede each partition's first row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .joins import join_small

# Rows one key may have before it is split over several tasks (a task handles this many comfortably).
MAX_KEY_ROWS = 1_000_000


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest ``keys`` group (one aggregate with map-side partial counts)."""
    g = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    r = g.agg(F.max("count").alias("m")).collect()[0]["m"]
    return int(r or 0)


def needs_split(df: DataFrame, keys: list[str], max_key_rows: int | None) -> bool:
    bound = MAX_KEY_ROWS if max_key_rows is None else max_key_rows
    return largest_key(df, keys) > bound


def join_on_keys(rows: DataFrame, per_key: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """``rows`` with the columns of its (partition, key) row in ``per_key``; null keys match null keys."""
    named = per_key.select(*[F.col(c).alias(f"_on_{c}") if c in (*on, *keys) else F.col(c) for c in per_key.columns])
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_on_{c}"))
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return join_small(rows, named, same).drop(*[f"_on_{c}" for c in (*on, *keys)])


def _sorted_checkpoint(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    cols = keys + order_by
    return (
        df.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    ).checkpoint(eager=True)


def with_ordinal(df: DataFrame, order_by: list[str], name: str, start: int = 0, partition_by: list[str] | None = None,
                 max_key_rows: int | None = None) -> DataFrame:
    """Add ``name`` = position of the row within its ``partition_by`` group in ``order_by`` order
    (0-based by default; global when no group). The order must be unique within a group.

    Groups up to ``max_key_rows`` rows use ``row_number`` (one task per group); a larger group is
    range-split over several tasks."""
    keys = list(partition_by or [])
    if not needs_split(df, keys, max_key_rows):
        w = Window.partitionBy(*keys).orderBy(*order_by)
        return df.withColumn(name, (F.row_number().over(w) - 1 + start).cast("long"))
    keyed = _sorted_checkpoint(df, keys, order_by)
    counts = keyed.groupBy("_pid", *keys).agg(F.count("*").alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", *keys, "_off", "_m0")
    out = join_on_keys(keyed, offs, ["_pid"], keys)
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0") + start).cast("long")).drop(
        "_pid", "_mid", "_off", "_m0"
    )


def lag_split(df: DataFrame, keys: list[str], order_by: list[str], cols: list[str], prefix: str = "prev_",
              max_key_rows: int | None = None, largest: int | None = None) -> DataFrame:
    """``lag(col)`` over ``Window.partitionBy(keys).orderBy(order_by)`` for each of ``cols``, computed so
    that a key holding more than ``max_key_rows`` rows is split over several tasks. ``largest``: rows of the largest key,
    where they are known; else ``df`` is computed once more to count them."""
    if not (needs_split(df, keys, max_key_rows) if largest is None else largest > (MAX_KEY_ROWS if max_key_rows is None else max_key_rows)):
        w0 = Window.partitionBy(*keys).orderBy(*order_by)
        out = df
        for c in cols:
            out = out.withColumn(f"{prefix}{c}", F.lag(c).over(w0))
        return out
    keyed = _sorted_checkpoint(df, keys, order_by)
    w = Window.partitionBy("_pid", *keys).orderBy("_mid")
    local = keyed
    for c in cols:
        local = local.withColumn(f"{prefix}{c}", F.lag(c).over(w))
    local = local.withColumn("_first", F.row_number().over(w) == 1)
    # the last row of every (partition, key), and for each the last row of the previous partition of that key
    last = keyed.groupBy("_pid", *keys).agg(F.max_by(F.struct(*cols), F.col("_mid")).alias("_last"))
    wp = Window.partitionBy(*keys).orderBy("_pid")
    carry = last.select("_pid", *keys, F.lag("_last").over(wp).alias("_carry"))
    out = join_on_keys(local, carry, ["_pid"], keys)
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"{prefix}{c}")))
    return out.drop("_pid", "_mid", "_first", "_carry")
