"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from fcverify import catalog
from fcverify.fixtures import DEAL_EVENTS
from fcverify.session import build_session

HEADLINE = (
    "summary", "score_hours", "expand_forecast", "nearest_obs", "asof_latest_obs", "asof_lag_join",
    "comparison", "rollup_skill", "persistence_bulk", "climatology_bulk", "decode_obs",
    "decode_forecast_groups", "causal_features", "sequence_windows", "reliability", "threshold_search",
    "gate_point", "bootstrap_hss", "nearest_grid", "prob_groups",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        DEAL_EVENTS: cpus})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    catalog.QUERIES["obs_category"](spark, sf_dir).collect()  # start-up is not measured
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
