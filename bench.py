"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from panelwright.catalog_queries import QUERIES
from panelwright.session import build_session

HEADLINE = ["quantile_spread", "calendar_grid_liquidation", "returns_panel", "fundamentals_asof", "factor_panel_full_outer", "amihud_signal", "prepare_signal", "backtest_pnl_net", "fm_gamma_single", "fm_two_pass"]
RUNS = 3


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, median of warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
