"""Headline queries, timed one after another; prints one JSON line.

Each query is run to completion with its rows written to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import time

from panelcast.catalog import QUERIES
from panelcast.session import get_session

HEADLINE = [
    "a1_aggregate_to_state",
    "j4_load_merged",
    "w1_lag_features_by_place",
    "w2_rolling_by_place",
    "w8_linear_interpolation",
    "c2_outliers_cap",
    "c9_fill_gaps_by_place",
    "c10_prepare_for_modeling",
    "c11_build_feature_set",
    "j5b_join_ocean_asof",
    "j6_spatial_lag",
    "a6_iqr_bounds_raw_rows",
    "q5_reduce_samples",
    "q10_baseline_forecasts",
    "m14_evaluate_forecast",
    "e6_calibrate_pooled",
    "e11_ensemble_flow",
    "v1_backtest_baselines",
    "v6_select_top_models",
    "q2_seasonal_regression",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM and the readers before the clock runs
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total_wall_time", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
