"""Checks that decide whether a one-task-per-group plan is allowed.

Per-curve windows are the cheapest plan (one exchange serves every step), but a
single curve may hold a large share of all rows. ``has_hot_group`` counts rows per
key with map-side partial aggregation, so the check itself never gathers a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumensift.session import hot_rows, task_count

#: Rows that a task sorts at once: more rows make more tasks, so that sorting them doesn't spill.
TASK_ROWS = 400_000


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys holding more than ``limit`` rows (at most total/limit of them)."""
    limit = hot_rows(df.sparkSession) if limit is None else limit
    return group_sizes(df, keys).where(F.col("group_rows") > limit).select(*keys)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` rows that are dealt by a key of small groups."""
    return max(task_count(spark), -(-rows // TASK_ROWS))


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when some key holds more rows than one task should sort."""
    limit = hot_rows(df.sparkSession) if limit is None else limit
    if not keys:
        return df.limit(limit + 1).count() > limit
    return not hot_groups(df, keys, limit).isEmpty()


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """Raise when ``keys`` repeat; returns ``df`` so calls chain."""
    bad = group_sizes(df, keys).where("group_rows > 1").limit(5).collect()
    if bad:
        raise ValueError(f"{name} repeats {list(keys)}: {[tuple(r)[:-1] for r in bad]}")
    return df


def require(df: DataFrame, condition, message: str) -> DataFrame:
    """Raise when any row breaks ``condition`` (NULL counts as broken)."""
    bad = df.where(~F.coalesce(condition, F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {bad}")
    return df


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row of ``df`` beside the single row of a global aggregate (a broadcast of one row, never a product)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.limit(1).withColumn("_one", F.lit(1))), "_one").drop("_one")
