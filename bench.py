"""Times the named queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs in full into a no-op sink. Arguments restrict the run to some queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "flow_rates", "parsed_values", "fingerprints", "rolling_fan_in", "arrival_intervals", "rolling_source",
    "flow_windows", "flow_windows_sliced", "dns_by_uid", "dns_window", "enriched_flows", "contract_violations", "char_entropy",
    "wire_messages", "top_contributions", "alert_page", "text_search", "stats_timeline", "correlate",
    "chain_summary", "kill_chains", "applied_codes", "group_split", "classification_report",
    "score_summary", "score_histogram", "row_checks", "isolation_scores", "trained_predictions", "boosted_predictions",
    "scored_flows", "stream_flow_features", "stream_dns_window", "stream_messages", "mixed_log_rows", "feature_job_rows",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowsift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from flowsift.catalog import QUERIES

    chosen = list(QUERIES) if "--all" in sys.argv else sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # starts the executor threads
    times = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "flow_windows_rows_per_sec": round(rows / times["flow_windows"]) if "flow_windows" in times else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
