"""Stage timing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_stages(events: DataFrame, *, request: str, stage: str, kind: str, ts: str, order: str) -> DataFrame:
    """start/end rows -> one record per end whose previous row of the same (request, stage) is a
    start (a later start replaces an earlier one; an end without a start is dropped).

    ``kind`` is 'start' or 'end'. Output: request, stage, end key, started_at, ended_at, duration_ms
    (2 decimals).
    """
    from ..plans.ordinals import lag_split

    # lag over (request, stage) by (ts, order), split so that a hot request spans several tasks
    e = events.select(request, stage, kind, ts, order, F.struct(F.col(kind).alias("k"), F.col(ts).alias("t")).alias("_cur"))
    e = lag_split(e, [request, stage], [ts, order], ["_cur"], prefix="_prev").withColumnRenamed("_prev_cur", "_prev")
    ends = e.filter((F.col(kind) == "end") & (F.col("_prev.k") == "start"))
    # milliseconds with 2 decimals, rounded in integer microseconds (nearest 10 us, half up), so the
    # value does not depend on the binary representation of a half
    us = F.timestamp_diff("MICROSECOND", F.col("_prev.t"), F.col(ts))
    dur = F.floor((us + 5) / 10) / 100.0
    return ends.select(
        request, stage, order,
        F.col("_prev.t").alias("started_at"), F.col(ts).alias("ended_at"), dur.alias("duration_ms"),
    )


def python_float_text(x: Column) -> Column:
    """A 2-decimal double printed as Python prints it (``1.5``, ``2.0``, ``86400000.0``)."""
    s = F.format_string("%.2f", x)
    s = F.regexp_replace(s, "0+$", "")
    return F.regexp_replace(s, "\\.$", ".0")


def timing_summary(stages: DataFrame, *, request: str, name: str = "stage", end_order: list[str] | None = None,
                   max_key_rows: int | None = None) -> DataFrame:
    """Per request: total = sum of all records (nested stages counted twice, as in the reference),
    the chain ``a(1.0ms) -> b(2.0ms)`` in completion order, and the number of stages.

    A request with more than ``max_key_rows`` records is built in two levels so that it is not gathered
    by one task: rows are range-split on (request, completion order); each partition joins its part of
    the chain, then the request joins at most one part per partition.
    """
    from ..plans.ordinals import _sorted_checkpoint, needs_split

    order = end_order or ["ended_at"]
    text = F.concat(F.col(name), F.lit("("), python_float_text(F.col("duration_ms")), F.lit("ms)"))
    base = stages.select(request, name, "duration_ms", *[c for c in order if c not in (request, name)])
    if not needs_split(base, [request], max_key_rows):
        g = base.groupBy(request).agg(
            F.round(F.sum("duration_ms"), 2).alias("total_ms"),
            F.count("*").alias("stages"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], text.alias("t")))),
                                     lambda x: x["t"]), " -> ").alias("chain_text"),
        )
        return g.select(request, "total_ms", "stages", "chain_text")
    keyed = _sorted_checkpoint(base, [request], order)
    parts = keyed.groupBy("_pid", request).agg(
        F.sum("duration_ms").alias("_sum"),
        F.count("*").alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_mid", text.alias("t")))), lambda x: x["t"]), " -> ").alias("_chain"),
    )
    g = parts.groupBy(request).agg(
        F.round(F.sum("_sum"), 2).alias("total_ms"),
        F.sum("_n").alias("stages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pid", "_chain"))), lambda x: x["_chain"]), " -> ").alias("chain_text"),
    )
    return g.select(request, "total_ms", "stages", "chain_text")


def timing_chains(stages: DataFrame, *, request: str, part_bytes: int, name: str = "stage", end_order: list[str] | None = None) -> DataFrame:
    """The chains of T2 in numbered parts of about ``part_bytes``: (request, part, chain_text), for requests of any size."""
    from ..plans.strings import ordered_parts

    order = end_order or ["ended_at"]
    text = F.concat(F.col(name), F.lit("("), python_float_text(F.col("duration_ms")), F.lit("ms)"))
    rows = stages.select(request, *[c for c in order if c != request], text.alias("_text"))
    return ordered_parts(rows, [request], order, "_text", " -> ", part_bytes, "chain_text")
