"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_depth_metrics",
    "a3_accuracy_wilson",
    "a8_multi_seed_accuracy",
    "a16_filter_summary",
    "a18_detection_table",
    "a19_depth_ceiling",
    "j1_resume",
    "j7_gap_to_best",
    "k7_distracted_export",
    "p1_scored_records",
    "r1_incremental_scoring",
    "s12_generate_problems",
    "w1_running_accuracy",
    "w6_chunk_fold",
    "w7_latest_per_id",
    "x9_final_answer",
    "x11_numeric_answer",
    "x20_expressions",
    "x24_split_clauses",
    "x26_route_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE

    from tallymark.plans import QUERIES
    from tallymark.session import local_session

    spark = local_session(cpus, "bench")
    spark.range(1).count()  # session start is no query time
    timings = {}
    for name in names:
        start = time.perf_counter()
        # every row and column is computed, none is kept
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
