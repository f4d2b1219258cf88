"""Headline-query benchmark: prints ONE JSON line with per-query seconds.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is timed end to end (plan + execution) with a full materialisation
through a no-op sink (``write.format("noop")``), which runs every stage without
moving results to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "company_summary",       # slice 0: dedup → enrich → summary
    "w01_dedup_first",
    "p04_enrich",
    "m03_normalise_salary",
    "f05_filter_region",
    "query_tool_page",
    "j02_match_recruiters",
    "g01_j03_company_report",
    "w07_upsert",
    "j09_match_candidate",
    "x05_extract_links",
]


def main() -> None:
    from lodestar.plans.catalog import QUERIES
    from lodestar.plans import fixtures
    from lodestar.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, partitions=int(cpus) * 2, app="lodestar-bench")
    spark.sparkContext.setLogLevel("ERROR")
    fixtures.SPREAD = int(cpus)
    names = [n for n in HEADLINE if n in QUERIES] + [n for n in sys.argv[1:] if n in QUERIES]
    times = {}
    # Warm-up: JVM start, parquet footer reads, codegen caches.
    QUERIES["w01_dedup_first"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
