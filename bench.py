"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the threads.
Every query is timed from building its plan to having computed all its rows. The
reconciliation and the table diff are rebuilt from the raw extracts for their ``_cold``
and ``_warm`` timings; their other result tables reuse the staged steps, as one run that
reports several tables would.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload import reconciliation, registry, tables  # noqa: E402

HEADLINE = (
    "reconcile_summary", "audit_union", "best_candidate", "midnight_recovery", "dedup_losers_reason", "extra_rows",
    "compare_matched", "compare_summary", "compare_unmatched", "occurrence_number", "multiset_match", "date_formats",
    "norm_code", "keyword_flag", "html_tables",
)


def run(df: DataFrame) -> None:
    """Compute every column of every row without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().collect()  # start the executors, not part of any timing

    def timed(name: str) -> float:
        start = time.perf_counter()
        run(registry.QUERIES[name][0](spark, sf_dir))
        return round(time.perf_counter() - start, 3)

    times = {}
    reconciliation.forget()
    times["reconcile_cold"] = timed("classify_outcomes")
    reconciliation.forget()
    times["reconcile_warm"] = timed("classify_outcomes")
    tables.forget()
    times["compare_cold"] = timed("compare_matched")
    for name in HEADLINE:
        times[name] = timed(name)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    with contextlib.suppress(Exception):
        spark.stop()


if __name__ == "__main__":
    main()
