"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query's best of two runs, its whole result written to a sink that drops it."""

from __future__ import annotations

import json
import os
import sys
import time

from tallyhold import queries
from tallyhold.session import local_session

HEADLINE = ("j1_a1_sync_summary", "j2_c1_c2_quick_classification", "c3_byte_classification", "c6_next_manifest", "j4_j6_extra_folders", "a3_a6_dedup_metrics", "a8_replacement_candidates", "a12_reference_names", "p3_a17_zip_packages", "f10_content_hashes")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            queries.queries()[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
