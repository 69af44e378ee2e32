"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default all).
Every result is written to Spark's ``noop`` sink, so all rows and columns are
computed and none passes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from veilframe.plans.catalog import CATALOG
from veilframe.sources.session import SPREAD

#: run once before anything is timed
WARM_UP = ("detect_entities_documents", "extract_json")

HEADLINE = (
    "spans_by_category", "detect_patterns_documents", "detect_entities_documents",
    "detect_sensitive_documents", "anonymize_documents", "anonymize_all_families",
    "detect_sensitive_notes", "restore_notes", "build_mapping_few_scopes",
    "anonymize_many_by_customer", "anonymize_many_conversations", "round_trip_conversations",
    "term_table_notes", "chat_system_first", "extract_json", "inquiries_logged",
    "pages_markdown", "documents_searched", "outbox_built", "calls_rolled_up",
    "mask_stream_documents", "mask_conversation_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config(SPREAD, str(4 * int(cpus)))  # the files here have one row group each
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        CATALOG[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]:
        start = time.perf_counter()
        CATALOG[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
