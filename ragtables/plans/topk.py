"""Top-k per group as a rank filter: Spark plans a partial WindowGroupLimit before the shuffle and a
final one after it, so only k rows per group and map partition cross the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, partition_by: list[str], order_by: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group (``row_number``: ties broken by the full order)."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    out = df.withColumn(rank_col, F.row_number().over(w))
    if k > 0:
        out = out.filter(F.col(rank_col) <= k)
    return out
