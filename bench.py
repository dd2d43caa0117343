"""Time the headline queries and print one JSON line.

Each query runs to a no-op sink, once to warm up and then BENCH_REPEATS times;
the median counts.  ``growth`` compares with the same queries on a ten times
smaller folder, BENCH_SMALL_DIR or the folder sf0.01 beside; empty for none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from rollbook.queries import QUERIES  # noqa: E402

HEADLINE = [
    "search_question", "filter_conjunction", "lexical_scan", "lexical_expanded", "retrieval_trace", "set_intersect", "fetch_records",
    "restrict_to_candidates", "statistics_long", "cross_tabs_all", "monthly_trend_lines", "top_categories", "landscape",
    "audit_columns", "audit_identical_fields", "audit_summary", "pack_batches", "batch_summary", "coverage", "clean_text", "search_shadow",
    "profile_columns", "normalize_candidates", "apply_normalization", "similar_values", "raw_preserved", "validate_findings",
    "evidence_index", "evidence_appendix", "feedback_to_lessons", "trigram_index", "scan_register", "lexical_trigram", "pack_sparse",
    "lexical_many_terms", "approx_distinct", "ledger_appends", "filter_table_dictionary",
    "register_question", "register_tables", "register_evidence", "dictionary_resolve_table", "validate_many_documents",
]


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def measure(spark: SparkSession, folder: str, repeats: int) -> dict[str, float]:
    times = {}
    for name in HEADLINE:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    beside = os.path.join(os.path.dirname(folder), "sf0.01")
    small = os.environ.get("BENCH_SMALL_DIR", beside if os.path.isdir(beside) and beside != folder else "")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rollbook-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = measure(spark, folder, repeats)
    result = {
        "metric": "headline queries, total of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }
    if small:
        before = measure(spark, small.rstrip("/"), repeats)
        result["growth"] = {n: round(times[n] / before[n], 2) for n in times}
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
