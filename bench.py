"""Benchmark the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma list, default the headline set).
Each query is run to completion (all result rows fetched) once after a warm-up
of the session; the value is the total of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hornbeam.plans.queries import QUERIES  # noqa: E402
from hornbeam.session import get_spark  # noqa: E402

HEADLINE = ["mine_join_3", "mine_join_2", "mine_binding_3", "join_star_range", "join_triangle"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    # warm-up: JVM start, parquet footers
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        t0 = time.time()
        rows[name] = len(QUERIES[name](spark, sf_dir).collect())
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "rows": rows, "sf": float(m.group(1)) if m else sf_dir,
           "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
