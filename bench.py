"""Benchmark the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line.  Each query is executed in full with the ``noop``
sink (nothing is collected to the driver); the reported time per query is
the median of $BENCH_REPEAT runs after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabsight.plans.registry import all_queries  # noqa: E402
from tabsight.session import build_session  # noqa: E402

HEADLINE = [
    "profile_table",
    "apply_pipeline",
    "correlation_matrix",
    "pareto",
    "resample",
    "trend",
    "breakdown",
    "descriptive",
    "quality_missing",
    "encode_label",
    "histogram",
    "group_aggregate_median",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = os.environ.get("BENCH_QUERIES")
    wanted = names.split(",") if names else HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          extra={"spark.driver.memory": "16g"})
    registry = {q.name: q for q in all_queries()}

    def run(name: str) -> float:
        t0 = time.perf_counter()
        df = registry[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("breakdown")  # warm-up: JVM, code generation, Python workers
    run("pareto")
    times = {}
    for name in wanted:
        if name not in registry:
            continue
        times[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
