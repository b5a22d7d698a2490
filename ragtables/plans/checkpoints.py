"""Cut lineage through the cluster's checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the folder of ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
