"""Joins whose broadcast side is size-checked at run time.

A side is broadcast only after measuring it: at most ``max_rows`` rows (a bounded ``limit(n+1)``), and Spark's size
of their columns times the rows within ``MAX_BROADCAST_BYTES``. Above that the join is a shuffle join and AQE's
skew-join split handles hot keys (enabled in ``local_session``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows and bytes under which a side is broadcast.
DEFAULT_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``MAX_BROADCAST_BYTES`` (reads at most max_rows + 1 rows)."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string" or kind == "binary":
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("array"):
            size = size + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        size = size + 16
    r = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return r["n"] <= max_rows and r["bytes"] <= MAX_BROADCAST_BYTES


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``big.join(small)`` with ``small`` broadcast when it is proven small, a shuffle join otherwise."""
    if fits(small, max_rows):
        small = F.broadcast(small)
    return big.join(small, on, how)
