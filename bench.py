"""Times the registered queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_RUNS (timed runs after one warm-up), BENCH_ONLY
(comma-separated name prefixes, or "all"; default: the headline queries below).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from askspark.session import local_session  # noqa: E402
from workload import registry  # noqa: E402


HEADLINE = (
    "r01 r03 r04 r06_join_tables r07 r08 r09 r11_trend_daily r12 r13_describe r14_distinct r15 p1 p4 p6 g01 g02 g05 k03 k04 s04 d03_chunk_documents "
    "d04 d05_bm25_top_k d06_dense_top_k d08 d10 d14_embed ask v01 v04_split_for v05 v07 v08 s08 t01_trace_rollup x01 x03"
).split()


def run(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    asked = os.environ.get("BENCH_ONLY", "")
    only = [] if asked == "all" else [p for p in asked.split(",") if p] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("askspark.tasks", spark.sparkContext.defaultParallelism)  # each table is one file here
    seconds = {}
    for name, fn in registry.QUERIES.items():
        if only and not any(name.startswith(p) for p in only):
            continue
        run(spark, fn, sf_dir)
        seconds[name] = round(statistics.median(run(spark, fn, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total warm time of the timed queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
