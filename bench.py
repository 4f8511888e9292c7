"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8);
BENCH_RUNS: timed runs of each query after a warm-up (default 3, the median counts).
Results are forced by a noop write.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "daily_activity", "hourly_activity", "scheduled_query_count", "time_functions", "filter_cmp", "map_column", "group_min_max_avg_sum", "two_stage_rollup",
    "left_join_nullable", "union_distinct", "order_limit", "firsts_in_windows", "first_last_nth", "lag_lead_default", "fixed_size_windows", "tumbling", "sliding",
    "session", "page_view_pipeline", "ip_to_country",
]


def main() -> None:
    from sluice.plans.catalogue import QUERIES
    from sluice.session import session

    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = session("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total of the median times of the headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
