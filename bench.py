"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion into a no-op sink, so all columns of all rows
are computed; the best of $BENCH_RUNS runs counts (after one warm-up pass of
the JVM by the query itself).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortspark.session import local_session  # noqa: E402
from queries.catalogue import QUERIES  # noqa: E402

HEADLINE = (
    "training_matrix", "label_table", "windowed_target", "transition_rates", "rank_family", "percent_rank_sliced",
    "ap_honours_family", "nested_average", "guarded_average", "contact_counts", "latest_per_key", "mode_repair",
    "assign_ids", "resolve_ids", "expectation_violations", "fk_violations", "numeric_clean", "job_a_gpa_by_year",
    "job_a_attendance", "auc_exact", "auc_large", "precision_top_k", "auc_by_window", "windowed_features", "bootstrap_auc_ci",
    "corr_matrix", "knn_vote",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    took = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - start
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found.group(1)) if found else None}
        )
    )


if __name__ == "__main__":
    main()
