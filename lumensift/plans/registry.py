"""Named queries over the driver tables, each with an optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumensift.plans.views import with_views
from lumensift.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a query; ``views`` are prefixed to ``sql`` as CTEs (SQL may add its own CTEs with a leading comma)."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(*views, body=sql) if views else sql
        return fn
    return wrap


def r(c: Column | str, digits: int = 6) -> Column:
    """Half-away rounding by scaling, the rule the SQL twin's engine uses; never a negative zero."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = F.lit(float(10 ** digits))
    return F.when(F.isnan(c), c).otherwise(F.signum(c).cast("bigint") * F.floor(F.abs(c) * scale + 0.5) / scale)
