"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full through the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "c2_split_fixed",
    "c4_split_recursive",
    "c6_split_semantic",
    "c8_split_structure",
    "c9_chunk_profiles",
    "r3_keyword_topk",
    "r4_vector_topk",
    "r9_retrieve_vector",
    "r6_rerank",
    "r7_rrf",
    "r10_retrieve_multi",
    "p5_answer",
    "v4_evaluate_cases",
    "v5_eval_summary",
    "s4_html_to_text",
    "s12_source_counts",
    "s13_upsert",
    "t2_timing_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from ragtables.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)) if cpus.isdigit() else 16, app="ragtables-bench")
    from ragtables.queries import QUERIES

    # untimed warm-up: JVM code paths and one Python worker round trip
    from pyspark.sql import functions as F

    spark.range(1000).select(F.sum("id")).collect()
    spark.range(1000).mapInArrow(lambda it: it, "id long").count()
    times, rows = {}, {}
    for name in names:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()  # each query computes its own index
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cores": cpus,
    }))


if __name__ == "__main__":
    main()
