"""Times the headline queries and prints one JSON line.

Each query is run once to warm up and then timed writing to a no-op sink, so that every row and
column is produced. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated, or "all") choose
the data, the cores and the queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from gazette.workload import QUERIES  # noqa: E402

HEADLINE = [
    "impressions_with_history",
    "labels",
    "wu_sampling",
    "map_list_fill",
    "popularity_baselines",
    "dynamic_history",
    "fixed_history",
    "examples_eval",
    "embedding_scores",
    "evaluate_all",
    "diversity",
    "serendipity",
    "novelty",
    "distribution",
    "split_fraction",
    "row_index",
    "encode_text",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(QUERIES) if names == "all" else names.split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
