"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (names, comma separated)
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "fa_laterality", "J5_passthrough_fates", "A10_passthrough_funnel", "J4_endpoint_extraction", "J1_scalar_sampling",
    "A2_morphology", "A5_scalar_summary", "A6_tract_profile", "J13_side_comparison", "S10_flat_report",
    "A3_density_map", "J8_J9_bundle_overlap", "J10_mean_closest_distance", "T1_top_by_overlap", "A13_bidirectional_stats",
    "A1_arc_length", "W3_orientation", "W6_resample", "A14_tracking_report", "F5_roi_masks", "A16_midline_x",
    "A17_midline_distance", "W4_jacobian", "A19_acquisition_quality", "W2_shells", "A27_series_analysis", "A28_tensor_ols",
    "A28_tensor_wls", "S11_cohort_table", "S7_study_scan", "F14_preflight", "S9_file_integrity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tractloom.plans import catalog
    from tractloom.session import local_session

    spark = local_session(cpus, "bench")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or list(HEADLINE)
    catalog.QUERIES["fa_laterality"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in names:
        t = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
