"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidelens import build_session
from tidelens.suite import all_queries

HEADLINES = (
    "agg_01_zone_state", "jon_04_radius_counts", "jon_03_nearest_zone", "agg_19_beach_state", "jon_06_training_rows",
    "jon_19_issued_in_time", "agg_13_scores", "win_01_latest_per_zone", "ram_01_zone_forecast", "ram_03_beach_forecast",
    "agg_11_tracks", "prj_08_flagged_cells", "win_16_connected_groups", "jon_28_interpolate_wind", "win_10_species_ranking",
    "scl_10_spot_rating", "str_01_fold", "snk_03_upsert")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(cores, max(cores, 8), app="bench")
    queries = all_queries()
    queries[HEADLINES[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
