"""Bench: seconds per report at $BENCH_SF_DIR on local[$BENCH_CPUS].

Like the reference's workflow (load the eight tables once, then run the
reports), the stand-in tables are first derived from the generated parquet
and written once as parquet in the shared work folder ("stage", timed and
reported apart). Each report then runs to completion on the staged tables
and is timed from submit to collected result (best of ``BENCH_REPEATS``).
``BENCH_STAGE=0`` runs the reports on the lazy derivation instead;
``BENCH_BUCKETS=n`` stages tables bucketed by join key.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.plans.kpi import kpi_summary  # noqa: E402
from marketlens.plans.reports import REPORTS  # noqa: E402
from marketlens.registry import DRIVER_PARAMS  # noqa: E402
from marketlens.session import get_session, scratch_path  # noqa: E402
from marketlens.sources.driver import driver_tables  # noqa: E402
from marketlens.sources.staging import stage_tables  # noqa: E402

PARAMS = {
    "q01_monthly_revenue": {"since": DRIVER_PARAMS["since"]},
    "q07_reviews_by_category": {"min_reviews": DRIVER_PARAMS["min_reviews"]},
    "q10_freight_by_category": {"min_avg_price": DRIVER_PARAMS["min_avg_price"]},
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    stage = os.environ.get("BENCH_STAGE", "1") != "0"
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))

    spark = get_session(f"local[{cpus}]", shuffle_partitions=partitions,
                        extra={"spark.sql.sources.bucketing.enabled": "true", "spark.driver.memory": "8g",
                               "spark.checkpoint.dir": tempfile.mkdtemp(prefix="marketlens-bench-")})
    t0 = time.time()
    tables = driver_tables(spark, sf_dir)
    stage_sec = 0.0
    if stage:
        buckets = int(os.environ["BENCH_BUCKETS"]) if os.environ.get("BENCH_BUCKETS") else None
        tables = stage_tables(spark, tables, scratch_path(spark, "bench-stage"), buckets=buckets,
                              files=None if buckets else cpus)
        stage_sec = time.time() - t0

    jobs = {name: (lambda t, fn=fn, p=PARAMS.get(name, {}): fn(t, **p)) for name, fn in REPORTS.items()}
    jobs["kpi_summary"] = lambda t: kpi_summary(t, since=DRIVER_PARAMS["since"])

    times: dict[str, float] = {}
    first: dict[str, float] = {}
    for name, job in jobs.items():
        best = None
        for _ in range(max(1, repeats)):
            s = time.time()
            job(tables).collect()
            el = time.time() - s
            first.setdefault(name, round(el, 4))
            best = el if best is None else min(best, el)
        times[name] = round(best, 4)
    spark.stop()

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_report_seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "first_run": first,
        "total_sec": round(time.time() - t0, 3),
        "stage_sec": round(stage_sec, 3),
        "staged": stage,
        "repeats": repeats,
        "cpus": cpus,
        "shuffle_partitions": partitions,
    }))


if __name__ == "__main__":
    main()
