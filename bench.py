"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plantspark.plans import QUERIES
from plantspark.session import local_session

HEADLINE = (
    "A1_tag_catalog", "A12_comprehensive", "A14_resample", "U4_merge_new_wins", "I1_incremental_merge", "W2_rolling_days", "H1_tag_freshness", "H12_gaps",
    "J5_nearest_speed", "P13_compensated_rows", "T1_sigma_runs", "T3_sigma_candidates", "T4_verified_candidates", "T13_tau_verified", "T16_statistical",
    "T24_breakouts", "T31_incident_report", "T35_combined_verdict", "M1_baseline_tuning", "M4_feature_matrix", "B2_period_methods", "T20_isolation_forest",
    "T22_speed_aware_report", "B8_sensitivity", "I4_new_files_only", "I11_refresh_cycle",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores, "plantspark-bench")
    # One throw-away query starts the JVM's worker threads and the scan code.
    QUERIES["A1_tag_catalog"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = [n for n in HEADLINE if n in QUERIES] if len(sys.argv) < 2 else sys.argv[1:]
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
