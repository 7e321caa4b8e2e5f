"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default HEADLINE), BENCH_WARMUP_DIR (an untimed warm-up
pass of the flagship, default the sf0.001 tables). Each query runs to completion through
the ``noop`` sink (full execution, nothing collected to the driver); the time of
the best of BENCH_REPEAT runs (default 3; once where a run takes over 15 s) is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fundflow import catalog  # noqa: E402
from fundflow.session import env_int, get_spark, shared_dir  # noqa: E402

HEADLINE = [
    "candidate_spending_summary",
    "election_spending_summary",
    "inside_accumulated",
    "outside_first_wins",
    "candidates_last_wins",
    "candidates_clean",
    "person_names",
    "fk_rejects",
    "spending_page_by_outside_total",
    "candidate_list_by_cycle",
    "spending_hierarchy",
    "spending_hierarchy_all",
    "merge_result",
    "merge_duplicate_stats",
    "paged_source",
    "refresh_chain",
    "pipeline_batch",
    "incremental_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = env_int("BENCH_CPUS", 8)
    repeat = max(1, env_int("BENCH_REPEAT", 3))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="fundflow-bench",
                      extra={"spark.driver.memory": "16g",
                             "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    shared_dir(spark)  # session's spark.checkpoint.dir, or a scratch folder when unset
    qs = catalog.queries()
    # JVM / codegen warm-up, not timed: the flagship once on the smallest scale factor
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        qs["election_spending_summary"](spark, warm).write.format("noop").mode("overwrite").save()
    else:
        spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
            if dt > 15:
                break
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
