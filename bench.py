"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR   folder with the parquet tables (default sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     warm runs per query, the median counts (default 2)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline set)
BENCH_DETAIL   a path: also write cold time, warm median and row count per query there
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyslot import catalog, session

HEADLINE = [
    "report_debtors", "customer_balance", "report_headline", "view_lessons", "lesson_details", "list_lessons",
    "monthly_revenue", "revenue_analysis", "vehicle_utilisation", "instructor_workload", "instructor_performance",
    "customer_lifecycle", "customer_value_segments_repeated", "scheduling_efficiency", "financial_health",
    "lesson_completion_metrics", "payment_history", "slot_conflicts", "running_balance", "payment_batch",
    "cancellation_batch", "booking_batch", "address_resolve", "lesson_audit", "login_lockout", "user_delete",
    "dq_orphans", "stream_balance", "stream_monthly_revenue", "apply_customer_changes", "booking_balances",
    "customer_change_batch", "customer_onboarding", "apply_lesson_changes", "lesson_update_batch", "stream_lesson_audit",
    "stream_booking",
]


def run_once(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.queries()) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = session.build(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run_once(spark, "scan_project", folder)
    times, detail = {}, {}
    for name in names:
        cold = run_once(spark, name, folder)
        warm = statistics.median(run_once(spark, name, folder) for _ in range(runs)) if runs else cold
        times[name] = round(warm, 3)
        if os.environ.get("BENCH_DETAIL"):
            detail[name] = {
                "cold": round(cold, 3), "warm": times[name], "rows": catalog.run(name, spark, folder).count()
            }
        print(f"{name}: cold {cold:.2f}s warm {warm:.2f}s", file=sys.stderr, flush=True)
    if detail:
        with open(os.environ["BENCH_DETAIL"], "w") as f:
            json.dump(detail, f, indent=1)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
