"""Time the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional), BENCH_REPEAT (default 2; best run is kept).
Each query is built from the parquet tables and fully computed through the
no-op sink, so the time covers planning, the bounded size checks and execution.
The first run of a plan also pays code generation and JIT compilation, a fixed
cost that does not grow with the data; those first-run times are reported
separately under ``cold_queries``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.config import build_session  # noqa: E402
from cohortlens.plans.registry import build  # noqa: E402

HEADLINE = [
    "q1_bar",
    "q1_bar_compat",
    "q1_box_summary",
    "q2_bar",
    "q2_bar_compat",
    "q2_box_summary",
    "category_gap",
    "potential_elite_candidates",
    "length_outliers",
    "stage_counts",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    build(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus * 2)))
    # JVM start and JIT warm-up, not timed: one pass over the review stage.
    build("review_lengths", spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, cold = {}, {}
    for name in names:
        runs = [run_once(spark, name, sf_dir) for _ in range(repeat)]
        cold[name] = round(runs[0], 3)
        times[name] = round(min(runs), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold_queries": cold,
                "repeat": repeat,
                "cpus": cpus,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
