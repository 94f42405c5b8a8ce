"""Seconds for each headline query on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from wattloom.plans import catalog
from wattloom.session import local_session

HEADLINES = [
    "unpivot_slots", "pivot_channels_complete", "meter_mapping_resolved", "weather_hourly_join", "sun_class_month", "upsample_ffill", "interpolate_linear", "event_counts", "sessions", "session_features",
    "feature_table", "rolling_median", "ev_sessions", "battery_cycles", "overlap_anti", "all_events", "day_grid_96", "roc_auc_weighted", "average_precision", "search_tokens", "key_explode_join",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    catalog.sessions(spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts workers and compiles what all share
    taken = {}
    for name in HEADLINES:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
