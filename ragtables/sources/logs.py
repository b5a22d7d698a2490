"""Stage records from log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stage-end line format (fields parted by " | ").
STAGE_LINE_REGEX = (
    r"^(.*?) \| (\w+) \| (.*?) \| (API_STAGE_END|STAGE_END) \| (.*?) \| started_at=(\S*) \| ended_at=(\S*) \| duration_ms=([-0-9.eE]+)\s*$"
)


def parse_stage_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """``time | level | logger | STAGE_END | name | started_at=.. | ended_at=.. | duration_ms=..``
    (also ``API_STAGE_END``) -> (logged_at, level, marker, name, started_at, ended_at, duration_ms).

    A time or duration that cannot be read is null; the line is kept."""
    x = F.col(col)
    m = lines.filter(x.rlike(STAGE_LINE_REGEX))
    g = lambda i: F.regexp_extract(x, STAGE_LINE_REGEX, i)
    return m.select(
        g(1).alias("logged_at"), g(2).alias("level"), g(4).alias("marker"), g(5).alias("name"),
        g(6).try_cast("timestamp_ntz").alias("started_at"), g(7).try_cast("timestamp_ntz").alias("ended_at"),
        g(8).try_cast("double").alias("duration_ms"),
    )


def read_stage_log(spark, path: str) -> DataFrame:
    return parse_stage_log(spark.read.text(path))
