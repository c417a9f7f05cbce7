"""Seconds per headline query: ``python bench.py`` prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tapewright.plans import load
from tapewright.plans.registry import REGISTRY
from tapewright.session import build_session

HEADLINE = (
    "bars_from_ticks bars_resampled bars_merged_loads bar_validation volume_outlier_cap daily_brand_range five_minute_signals index_features "
    "price_features volume_features technical_features feature_matrix feature_statistics feature_correlations boxes_by_label "
    "turning_points_strict labels_next_bar labelling_grid at_the_money entry_quotes contract_of_the_day put_values "
    "average_precision precision_recall_curve timing_errors signal_pairs time_split ratio_split walk_forward_folds "
    "strategy_bar_log strategy_trades equity_curves grid_comparison ensemble_weights stored_bars_merged streamed_bars streamed_positions"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    load()
    names = sys.argv[1:] or HEADLINE
    REGISTRY["bars_from_ticks"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
