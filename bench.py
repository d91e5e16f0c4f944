"""Times the headline queries and prints one JSON line.

Each query runs once to warm the JVM and once timed; the timed run writes to a sink
that drops the rows, so nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from glycospark.plans import all_queries
from glycospark.session import local_session

HEADLINE = (
    "flagship_patient_scores",
    "agg2_regularize",
    "join5_asof_nearest",
    "win6_interpolate_small_gaps",
    "win7_segments",
    "win13_rollover_temp",
    "win17_cgm_features",
    "phy3_physiological_features",
    "spl3_hybrid_holdout",
    "epi1_midnight_episodes",
    "epi4_sliding_windows",
    "eva3_wql",
    "eva4_brier",
    "eva7_eva8_coverage_sharpness",
    "eva12_pit_values",
    "eva15_dilate",
    "eva17_nocturnal_overall",
    "eva19_horizon_profile",
    "eva22_episode_classification",
    "ldb8_grand_summary_best",
    "mea2_greedy_meal_merge",
    "snk2_bounded_files",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores, tempfile.mkdtemp(prefix="bench-"))  # one machine
    queries = all_queries()[0]
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
