"""Time the headline queries and print one JSON line.

Each query is run to completion with a no-op sink, so all columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docketry.plans.catalog import QUERIES
from docketry.session import local_session

HEADLINE = ["classify", "apply_state", "doc_extract", "case_extract", "upset_board", "doc_event_link", "case_page", "case_list",
            "doc_budget", "parcel_match", "enrich_status", "new_events", "class_doc_stats", "case_detail", "case_page_events"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="docketry-bench")
    QUERIES["class_counts"].run(spark, folder).write.format("noop").mode("overwrite").save()  # start-up out of the way
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
