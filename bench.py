"""Time the headline queries and print one JSON line.

Each query is run to its last row with the ``noop`` sink. ``BENCH_SF_DIR`` names the data folder,
``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "profile_lineitem",
    "profile_orders",
    "profile_nulls",
    "profile_all_tables",
    "profile_approx_ranges",
    "accepted_values",
    "suggest_orders",
    "suggest_orders_refined",
    "id_rules",
    "schema_drift",
    "drift_summary",
    "manifest_models",
    "manifest_audit",
    "coverage_by_group",
    "project_scores",
    "worst_groups",
    "graph_nodes",
    "orphans",
    "fan_out",
    "node_depths",
    "max_depth",
    "health_dashboard",
    "registry_merge",
    "adhoc_sql",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start-up is not part of any query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
