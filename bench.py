"""Headline operators timed on one machine; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores.  Each time is the median
of three runs after one warm-up pass over all of them; every run computes the whole result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cairnbook.operators import profile  # noqa: E402
from cairnbook.plans import QUERIES  # noqa: E402
from cairnbook.session import local_session  # noqa: E402

HEADLINE = {
    "t4_preview": "t4_preview",
    "t1_ranked_search": "t1_ranked_search",
    "a14_folder_fingerprint": "a14_folder_fingerprint",
    "j2_manifest_diff": "j2_manifest_diff",
    "j4_schema_diff": "j4_schema_diff",
    "sk2_catalog_upsert": "sk2_catalog_upsert",
    "q3_guarded_group_by": "q3_group_order_limit",
    "a7_query_stats": "a7_query_stats",
    "w3_gap_sessions": "w3_gap_sessions",
    "j7_join_mining": "j7_join_mining",
    "f25_html_to_markdown": "f25_html_to_markdown",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    runs = {"a1_full_profile": lambda: profile.profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))}
    runs["a1_full_profile_exact"] = lambda: QUERIES["a1_full_profile_exact"](spark, sf_dir)
    for label, name in HEADLINE.items():
        runs[label] = lambda name=name: QUERIES[name](spark, sf_dir)

    def timed(make) -> float:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for make in runs.values():
        timed(make)
    times = {label: round(statistics.median(timed(make) for _ in range(3)), 3) for label, make in runs.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
