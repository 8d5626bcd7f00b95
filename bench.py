"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("OMP_NUM_THREADS", "1")

from lumensift.plans import catalogue
from lumensift.session import build_session

HEADLINE = ("noisiest_targets", "search_peaks", "consolidated_clusters", "recovery_cell_grid", "truth_labelled_peaks", "vet_features", "median_filter_cotrend",
            "spline_detrend", "detector_summary", "nearest_time_join", "peak_features", "stratified_splits")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.local.dir": tmp, "spark.sql.warehouse.dir": tmp + "/wh", "spark.checkpoint.dir": tmp + "/ck"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    catalogue.QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles code and starts workers; not timed
    seconds = {}
    for name in names:
        t = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
