"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waybill.session import local_session  # noqa: E402
from waybill.sources.sinks import stored  # noqa: E402
from workload import load_all  # noqa: E402
from workload.tables import Tables  # noqa: E402
from workload.whole_work import plan_of, verification_of  # noqa: E402

# The stages of a migration (plan, then verify and report), and the widest single operators.
PLAN = [
    "cells_long", "value_map_join", "resolve_users", "task_body", "build_actions", "build_links",
    "adopt_existing", "route_findings", "merge_action_outcome", "plan_summary", "seal_plan",
]
VERIFY = [
    "diff_expected_actual", "item_status_from_checks", "verification_counts", "verify_links",
    "reconcile_matches", "report_items", "not_preserved", "top_problems",
]
OTHER = [
    "aggregate_findings", "merge_findings", "fold_checkpoints", "consecutive_failures",
    "canonical_order", "render_documents", "scrub_secrets", "leak_scan", "convert_date",
    "cycle_check", "stream_event_counts",
]
# One call each: all actions with their payloads, and those compared with the destination.
WHOLE = ["migration_plan", "migration_verification"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry = load_all()
    spark = local_session(cpus, partitions=int(cpus))
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # the session itself is not measured
    times: dict[str, float] = {}
    for name in PLAN + VERIFY + OTHER + WHOLE:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    # The same apart: planning and storing the plan, then verifying what is stored.
    start = time.perf_counter()
    actions = stored(plan_of(Tables(spark, sf_dir))["actions"], "bench-plan")
    times["plan_and_store"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    verification_of(actions).write.format("noop").mode("overwrite").save()
    times["verify_stored"] = round(time.perf_counter() - start, 3)
    total = lambda names: round(sum(times[n] for n in names), 3)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": total(PLAN + VERIFY + OTHER + WHOLE),
                "unit": "sec",
                "queries": times,
                "stages": {
                    "plan": total(PLAN), "verify": total(VERIFY), "whole_plan": times["plan_and_store"], "whole_verify": times["verify_stored"],
                },
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
