"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. The panels are made once, before the timing, as the baseline's are."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from panelframe.plans import catalog

HEADLINES = [
    "flagship", "t_rolling_zscore", "t_rolling_rank", "t_rolling_percentile", "t_rolling_sum", "t_rolling_ols", "t_rolling_ridge", "t_rolling_lasso",
    "t_rolling_elastic_net", "t_orthogonalize", "t_ewm_mean", "c_rolling_corr", "t_winsorize", "t_group_zscore", "p_ic_weighted",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, failed = catalog.queries(), {}, {}
    queries["flagship"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warms up, and makes the panels' base
    for name in HEADLINES:
        began = time.time()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # the other figures are still wanted
            failed[name] = str(e)[:200]
            continue
        times[name] = round(time.time() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "failed": failed, "sf": sf_dir}))


if __name__ == "__main__":
    main()
