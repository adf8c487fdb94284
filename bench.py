"""Headline queries on a warm JVM; prints one JSON line.

Shared stages are dropped before each run, so a query pays for everything it needs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oddsloom.plans import catalog  # noqa: E402
from oddsloom.plans.library import CATALOG  # noqa: E402
from oddsloom.session import local_session  # noqa: E402

QUERIES = (
    "line_pricing_quality",
    "reference_estimate",
    "leave_one_out_pricing",
    "roster_status",
    "quote_unnest",
    "backtest_summary",
    "segment_scoreboard",
    "walk_forward_map",
    "rolling_priors",
    "minutes_features",
    "possessions",
    "day_completeness",
    "snapshot_diff",
)
# The whole strategy job takes minutes on one machine; BENCH_ALL=1 adds it.
if os.environ.get("BENCH_ALL"):
    QUERIES = (*QUERIES, "strategy_candidates")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, app="oddsloom-bench")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(4, 2 * int(cpus))))

    def once(name: str) -> float:
        catalog._STAGES.clear()
        start = time.perf_counter()
        CATALOG[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    once(QUERIES[0])  # warms the JVM
    for name in QUERIES:
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {times[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
