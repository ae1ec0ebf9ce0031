"""Benchmark of the headline queries.

Runs each query to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver) on ``local[$BENCH_CPUS]`` over
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), and prints one JSON line:
{"metric": "total_query_sec", "value": ..., "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parkops.plans.registry import QUERIES  # noqa: E402
from parkops.session import build_session  # noqa: E402

HEADLINE = [
    "invoice_ledger",            # C1: six-table left-join chain
    "payments_by_method",        # D2: aggregate over the payment view
    "total_revenue",             # D1
    "requests_by_garage",        # D4: three-way join + group by name
    "request_spot_garage",       # C2: five-table inner chain
    "repeat_requesters",         # C8: semi join over HAVING
    "never_used_not_in",         # C9: null-aware anti join
    "board_order",               # G1 + F3: unified board with positions
    "recent_requests",           # F5: top-10 per user
    "my_vehicles",               # B17: positions inside every owner's list
    "user_activity",             # C13: correlated counts
    "garage_occupancy",          # D5
    "status_counts",             # D6
    "user_kpis",                 # D11
    "dq_unique",                 # J1: every key of every table
    "dq_foreign_key",            # J4: every reference
    "apply_request_decisions__requests",   # I1
    "apply_payments__payments",  # I11
    "delete_vehicle_cascade__payments",    # I8
    "purge_users__payments",     # I9
    "register_users__users",     # I17
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=2 * cpus, app="parkops-bench")
    # warm-up: JVM, parquet footers, codegen of the common view projections
    QUERIES["total_revenue"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
           "spark": spark.version}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
