"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: folder of the tables; BENCH_CPUS: cores."""

from __future__ import annotations

import json
import os
import time

from lakemill.plans.queries import QUERIES
from lakemill.session import create_session

HEADLINE = [
    "nation_revenue", "filter_compare", "join_inner_multi", "join_bucketed", "join_three_group", "semi_in", "anti_not_in", "exists_corr",
    "agg_global", "agg_count_distinct", "agg_group_threshold", "agg_group_percentile_disc", "win_row_number", "win_rank", "win_running_sum",
    "sort_multi", "union_distinct", "scalar_correlated", "any_all", "math_trig", "str_funcs", "date_add_sub", "if_case", "stream_windows",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = create_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up: files in cache, code compiled
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
