"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterloom.plans import load_catalog  # noqa: E402
from meterloom.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_channel_report", "w02_episodes", "w02_episodes_hot_meter", "w07_hysteresis_samples", "w13_rolling_mean_median", "w18_sessions", "w24_chained_runs",
    "g01_hold_energy", "g03_uncapped_energy", "a04_on_thresholds", "a07_channel_battery", "a08_scan_groups", "a12_bucket_resample", "a20_simultaneity", "a35_psi",
    "j04_nearest_to_grid", "j08_overlap_pairs", "j14_readings_in_episodes", "m04_device_scores", "m13_joint_decode", "m22_classify_events", "v01_cycle_power", "r01_stream_bucket_means",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    warm = catalog["w02_episodes"].run(spark, folder)
    warm.write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
