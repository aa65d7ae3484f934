"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query runs once to warm
up and then three times, with all rows written to the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from queries import FOUND
from voxloom.session import local_session

HEADLINE = [
    "catalog_refresh", "top_n_balanced", "plan_samples", "digit_filter", "duration_budget", "cap_and_budget",
    "build_subset", "build_dataset", "holdout_split", "clip_uid", "manifest_vits", "stream_filter",
]
RUNS = 3


def timed(spark, run, sf_dir: str) -> float:
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    seconds = {}
    for name in HEADLINE:
        timed(spark, FOUND[name], sf_dir)
        seconds[name] = round(statistics.median(timed(spark, FOUND[name], sf_dir) for _ in range(RUNS)), 3)
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
