"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quarrylens import catalog  # noqa: E402
from quarrylens.session import get_spark  # noqa: E402

HEADLINE = (
    "e6_links_by_host_class",
    "e6_html_units",
    "a4_pages_by_host",
    "x6_index_records",
    "x3_trigram_counts",
    "x10_search_substring",
    "x12_search_regex",
    "x13_search_fuzzy",
    "x18_search_surfaces",
    "r1_secret_findings",
    "r4_redaction",
    "a8_endpoint_evidence",
    "g3_crawl",
    "f2_dsl_events",
    "a7_called_endpoints",
    "w6_near_duplicate_runs",
    "j6_as_of_events",
    "j4_benchmark_containment",
    "a19_conversation_reassembly",
    "a5_size_by_flag",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark("bench", f"local[{cpus}]", **{"spark_sql_shuffle_partitions": cpus, "spark_driver_memory": "12g", "spark_ui_enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "headline query seconds (sum of medians)", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
