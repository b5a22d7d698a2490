"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch of whole texts.
BATCH_ROWS = 1000


def spread(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread the rows of a table scan over all cores before CPU-heavy work on each row.

    ``scan`` must be a plain file scan: its partition count is then known without running a job. Only a scan
    with fewer partitions than the cluster has cores (a small file) is repartitioned; a large one stays as it
    is, so no shuffle is added at scale.
    """
    target = partitions or scan.sparkSession.sparkContext.defaultParallelism
    # round-robin repartition sorts rows first (spark.sql.execution.sortBeforeRepartition), so a
    # retried task sees the same rows
    return scan.repartition(target) if scan.rdd.getNumPartitions() < target else scan


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows from now on: whole texts are long, and Spark bounds batches by rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
