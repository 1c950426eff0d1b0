"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The value is the sum of each query's median of three runs, after one run that warms up.
"""

import json
import os
import statistics
import time

from siskin import registry
from siskin.session import session

HEADLINES = (
    "flagship", "lb_filtered_three_way_join", "lb_redundant_aggs_false_left_join", "lb_no_match_join", "lb_rank_topk", "lb_composite_filter",
    "lb_virtual_three_way_join", "join_theta_lt", "agg_null_group", "count_distinct", "win_mixed_partitions", "win_running_sum", "topn_per_group", "graph_khop_nested", "cte_reuse",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        runs = []
        for _ in range(4):
            began = time.time()
            registry.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
