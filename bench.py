"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times (default 3); the best
time counts. A control query, a plain count of the same rows, tells how fast the machine was:
its time before and after is in the line too, and no part of the sum. ``BENCH_SF_DIR`` and
``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import QUERIES  # noqa: E402
from workload.session import local_session  # noqa: E402

HEADLINE = (
    "freq_single", "freq_multi", "freq_mentioned", "freq_all_kinds", "label_coded",
    "layout_compare", "mean_stats", "mean_trimmed", "mean_trimmed_ties", "cross_single",
    "cross_multi", "cross_mean", "report_freq_single", "report_base_multi", "report_assembled",
    "report_means", "freq_mixed_types", "report_many_options", "cross_many_groups", "mean_trimmed_by",
    "report_two_batches",
)


def control(spark, sf_dir: str) -> float:
    start = time.perf_counter()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "sum(l_quantity)", "count(distinct l_suppkey)").collect()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session()
    control(spark, sf_dir)
    controls = [control(spark, sf_dir)]
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "control": [*controls, control(spark, sf_dir)],
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
