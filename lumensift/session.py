"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that matter for plans; everything else is left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # top-n-per-group filters are cut map-side up to this n
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
}

#: Groups with more rows than this leave the one-task-per-group plans.
HOT_ROWS_KEY = "lumensift.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000


def build_session(app: str = "lumensift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``master`` only for local runs."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    """Row count above which a group is treated as hot."""
    return int(spark.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def task_count(spark: SparkSession) -> int:
    """Tasks for steps whose work isn't told by their bytes, which adaptive plans would put into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "lumensift")
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(sc.applicationId)
