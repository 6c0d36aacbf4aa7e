"""Headline queries at one scale factor; prints one JSON line.

Every query runs once to warm up and once timed, its result being written to Spark's no-op
sink so that no time goes into collecting rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "profile_columns",
    "completeness_labels",
    "format_validity",
    "outlier_events",
    "domain_rule",
    "uniqueness_documents",
    "ref_orphans",
    "consistency_part",
    "fuzzy_dedup",
    "normalise_signals",
    "er_components",
    "er_full",
    "er_customers",
    "dq_report",
    "scorecard",
    "cleanse_bulk",
    "cleanse_amounts",
    "audit_cells",
    "review_apply",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus=cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in only:
        run(name)
        seconds[name] = round(run(name), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
