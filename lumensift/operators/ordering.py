"""Global order without a single-task sort, and safe lineage cuts."""

from __future__ import annotations

from collections.abc import Sequence
import tempfile

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.session import hot_rows
from lumensift.operators.skew import with_row


#: Rows that one window task orders; more are cut into ranges first.
ONE_WINDOW_ROWS = 100_000


def shared_folder(spark) -> str:
    """The checkpoint folder that all executors share; on one machine a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder so later steps survive lost executors and do not recompute."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_global_row_number(df: DataFrame, order: Sequence[Column], out: str = "row_number", limit: int | None = None,
                           n_splits: int = 256) -> DataFrame:
    """1-based position in ascending ``order`` (negate numbers for descending; end with a unique key).

    Small tables use one window. Larger ones are dealt over ranges of the order and written once; a row's position is its place in its
    sorted range plus the number of rows in earlier ranges. Any cut points give exact positions.
    """
    limit = min(hot_rows(df.sparkSession), ONE_WINDOW_ROWS) if limit is None else limit
    n = df.count()
    if n <= limit:
        return df.withColumn(out, F.row_number().over(W.orderBy(*order)).cast("bigint"))
    ranges = df.repartitionByRange(min(n_splits, -(-4 * n // max(limit, 1))), *order).sortWithinPartitions(*order)
    d = cut_lineage(ranges.withColumn("_id", F.monotonically_increasing_id()))  # range in the upper bits, place in the lower 33
    d = d.withColumn("_part", F.shiftright("_id", 33))
    sizes = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offs = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # one row per range
    d = d.join(F.broadcast(offs), "_part", "left")
    return d.withColumn(out, F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_off")


def rank_bins(df: DataFrame, order: Sequence[Column], n_bins: int, out: str, limit: int | None = None) -> DataFrame:
    """Equal-population bins by global rank: floor(n_bins * (rank - 1) / n)."""
    df = cut_lineage(df)  # counted twice, cut into ranges and ordered
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    d = with_global_row_number(df, order, "_rn", limit).transform(with_row, total)
    return d.withColumn(out, F.floor(F.lit(n_bins) * (F.col("_rn") - 1) / F.col("_total")).cast("int")).drop("_rn", "_total")
