"""Grouped order statistics: medians, MAD scales, percentiles, clipped moments.

Two plans give the same exact numbers:

* ``direct``: window or aggregate ``percentile`` on groups small enough for a task;
* ``narrowed``: repeated histogram narrowing. Each round is a partially aggregated
  count per (group, bucket), so a group holding a third of all rows never meets in
  one task; three rounds of 1,024 buckets shrink it a billion-fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions.consts import MAD_SIGMA
from lumensift.operators.ordering import ONE_WINDOW_ROWS, cut_lineage
from lumensift.operators.skew import with_row
from lumensift.session import hot_rows


def finite(c: Column) -> Column:
    """Neither NULL nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become NULL (NULL is the engine's only missing value)."""
    return F.when(finite(c), c)


def _narrow(rows: DataFrame, keys: list[str], ranks: DataFrame, bins: int, rounds: int) -> DataFrame:
    """(keys, rank, v): the rank-th smallest ``v`` per key, rank counted from 0."""
    state = ranks
    for _ in range(rounds):
        width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
        bucket = F.when(F.col("hi") > F.col("lo"),
                        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1).cast("bigint"))
                        ).otherwise(F.lit(0).cast("bigint"))
        hist = (
            rows.join(state, keys)
            .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
            .groupBy(*keys, "rank", "below", bucket.alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        upto = F.col("below") + F.sum("n").over(W.partitionBy(*keys, "rank").orderBy("b"))
        state = (
            hist.withColumn("upto", upto)
            .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
            .select(*keys, "rank", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi")
        )
        state = cut_lineage(state)
    tail = (
        rows.join(state, keys)
        .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        .groupBy(*keys, "rank", "below", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.col("below") + F.sum("n").over(W.partitionBy(*keys, "rank").orderBy("v"))
    return (
        tail.withColumn("upto", upto)
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        .select(*keys, "rank", "v")
    )


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: dict[str, float],
    hot: bool = False,
    bins: int = 4096,
    rounds: int = 2,
) -> DataFrame:
    """One row per key with linearly interpolated quantiles ``{name: p}``; missing values skipped."""
    keys = list(keys)
    names = list(probs)
    if not hot:
        c = finite_or_null(value)
        return df.groupBy(*keys).agg(*[F.percentile(c, float(p)).alias(n) for n, p in probs.items()])
    whole = not keys
    if whole:
        keys = ["_all"]
        df = df.withColumn("_all", F.lit(1))
    # every round reads the rows again, so they are written once
    rows = cut_lineage(df.select(*keys, value.alias("v")).where(finite(F.col("v"))))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    pos = lambda p: F.lit(float(p)) * (F.col("m") - 1)
    ks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(pos(p)), F.ceil(pos(p))) for p in probs.values()])))
    ranks = stats.select(*keys, F.explode(ks).alias("rank"), F.lit(0).cast("bigint").alias("below"), "lo", "hi")
    found = _narrow(rows, keys, cut_lineage(ranks), bins, rounds)
    lookup = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    base = df.select(*keys).distinct().join(stats, keys, "left").join(cut_lineage(lookup), keys, "left")
    out = []
    for n, p in probs.items():
        low, high = F.col("at")[F.floor(pos(p))], F.col("at")[F.ceil(pos(p))]
        out.append((low + (high - low) * (pos(p) - F.floor(pos(p)))).alias(n))
    return base.select(*([] if whole else keys), *out)


def level_quantiles(levels: DataFrame, key: str, value: str, count: str, probs: dict[str, float], n_splits: int = 64) -> DataFrame:
    """``_key`` and exact linearly interpolated quantiles of few, large groups, from their distinct values with counts.

    Levels are dealt over ranges of (key, value); a range's running count starts at the total of the ranges before it, so neither a
    group nor its levels meet in one task.
    """
    d = cut_lineage(levels.select(F.col(key).alias("_key"), F.col(value).alias("v"), F.col(count).alias("n")).repartitionByRange(n_splits, "_key", "v").withColumn("_part", F.spark_partition_id()))
    size = d.groupBy("_key", "_part").agg(F.sum("n").alias("_s"))  # few rows: groups and ranges
    size = size.select("_key", "_part", F.coalesce(F.sum("_s").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_s").over(W.partitionBy("_key")).alias("m"))
    j = d.join(F.broadcast(size.withColumnsRenamed({"_key": "_k", "_part": "_p"})), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    upto = F.col("_off") + F.sum("n").over(W.partitionBy("_key", "_part").orderBy("v"))
    j = j.withColumn("upto", upto)
    pos = lambda p: F.lit(float(p)) * (F.col("m") - 1)
    at = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("v")))
    aggs = [a for name, p in probs.items() for a in (at(F.floor(pos(p))).alias(f"_lo_{name}"), at(F.ceil(pos(p))).alias(f"_hi_{name}"))]
    g = j.groupBy("_key").agg(F.first("m").alias("m"), *aggs)
    share = lambda p: pos(p) - F.floor(pos(p))
    return g.select("_key", *[((1 - share(p)) * F.col(f"_lo_{n}") + share(p) * F.col(f"_hi_{n}")).alias(n) for n, p in probs.items()])


def column_quantiles(df: DataFrame, columns: Sequence[str], p: float, limit: int | None = None, width: float = 0.001) -> dict[str, float | None]:
    """The exact linearly interpolated quantile ``p`` of every column over the whole table; missing values skipped.

    Small tables use one aggregate. In larger ones a sketch brackets each quantile, rows below the bracket are counted and only the
    values inside of it are ordered, by distinct value; a bracket that the counts don't confirm becomes the column's whole range.
    """
    limit = min(hot_rows(df.sparkSession), ONE_WINDOW_ROWS) if limit is None else limit
    names = [f"c{i}" for i in range(len(columns))]
    d = df.select(*[finite_or_null(F.col(c).cast("double")).alias(n) for c, n in zip(columns, names)])
    if d.count() <= limit:
        return dict(zip(columns, d.agg(*[F.percentile(n, float(p)) for n in names]).first()))
    near = dict(zip(names, d.approxQuantile(names, [max(0.0, p - 2 * width), min(1.0, p + 2 * width)], width)))
    span = {n: (b[0], b[1]) if b else (0.0, 0.0) for n, b in near.items()}
    one = d.agg(*[x for n, (lo, hi) in span.items() for x in (F.count(n).alias(f"m_{n}"), F.count_if(F.col(n) < lo).alias(f"b_{n}"), F.count_if(F.col(n) <= hi).alias(f"u_{n}"))]).first()
    pos = {n: p * (one[f"m_{n}"] - 1) for n in names}
    sure = {n: one[f"b_{n}"] <= int(pos[n]) and one[f"u_{n}"] > min(int(pos[n]) + 1, one[f"m_{n}"] - 1) for n in names}
    inside = F.array(*[F.when(F.col(n).between(*span[n]) if sure[n] else F.col(n).isNotNull(), F.struct(F.lit(n).alias("name"), (F.col(n) + 0.0).alias("v"))) for n in names])
    seen = d.select(F.explode(F.array_compact(inside)).alias("x")).groupBy("x.name", "x.v").agg(F.count(F.lit(1)).alias("n"))
    start = {n: one[f"b_{n}"] if sure[n] else 0 for n in names}
    state = df.sparkSession.createDataFrame([(n, start[n], k) for n in names for k in {int(pos[n]), min(int(pos[n]) + 1, one[f"m_{n}"] - 1)} if one[f"m_{n}"]], "name string, below bigint, rank bigint")
    upto = F.col("below") + F.sum("n").over(W.partitionBy("name").orderBy("v"))
    at = seen.join(F.broadcast(state.select("name", "below").distinct()), "name").withColumn("upto", upto).join(F.broadcast(state.select("name", "rank")), "name").where(
        (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    found = {(r["name"], r["rank"]): r["v"] for r in at.select("name", "rank", "v").collect()}  # two a column at most
    out: dict[str, float | None] = {}
    for c, n in zip(columns, names):
        k = int(pos[n]) if one[f"m_{n}"] else 0
        low, high = found.get((n, k)), found.get((n, min(k + 1, one[f"m_{n}"] - 1)))
        out[c] = None if low is None else (k + 1 - pos[n]) * low + (pos[n] - k) * high if pos[n] > k else low
    return out


def with_median(df: DataFrame, keys: Sequence[str], value: Column, out: str, hot: bool = False) -> DataFrame:
    """Attach the group median of ``value`` as column ``out``."""
    if not hot:
        return df.withColumn(out, F.median(finite_or_null(value)).over(W.partitionBy(*keys)))
    return df.join(grouped_quantiles(df, keys, value, {out: 0.5}, hot=True), list(keys), "left")


def with_count(df: DataFrame, keys: Sequence[str], cond: Column, out: str, hot: bool = False) -> DataFrame:
    """Attach the number of group rows where ``cond`` holds."""
    n = F.count(F.when(cond, F.lit(1)))
    if not hot:
        return df.withColumn(out, n.over(W.partitionBy(*keys)))
    return df.join(df.groupBy(*keys).agg(n.alias(out)), list(keys), "left")


def with_agg(df: DataFrame, keys: Sequence[str], hot: bool = False, **aggs: Column) -> DataFrame:
    """Attach plain group aggregates; hot groups aggregate partially and join back."""
    if not hot:
        w = W.partitionBy(*keys)
        return df.withColumns({name: c.over(w) for name, c in aggs.items()})
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), list(keys), "left")


def median_mad(df: DataFrame, keys: Sequence[str], value: Column, hot: bool = False,
               med: str = "med", mad: str = "mad") -> DataFrame:
    """One row per key: median and raw median absolute deviation (two passes)."""
    keys = list(keys)
    base = df.select(*keys, finite_or_null(value).alias("_v"))
    centred = with_median(base, keys, F.col("_v"), "_m", hot)
    if not hot:
        return centred.groupBy(*keys).agg(
            F.first("_m").alias(med), F.percentile(F.abs(F.col("_v") - F.col("_m")), 0.5).alias(mad))
    mads = grouped_quantiles(centred, keys, F.abs(F.col("_v") - F.col("_m")), {mad: 0.5}, hot=True)
    return centred.groupBy(*keys).agg(F.first("_m").alias(med)).join(mads, keys)


def robust_scales(df: DataFrame, keys: Sequence[str], value: Column, hot: bool = False) -> DataFrame:
    """Median, MAD sigma with std fallback, and p68 of |x| with median-|x| fallback."""
    keys = list(keys)
    base = df.select(*keys, finite_or_null(value).alias("_v"))
    if hot:
        g = median_mad(base, keys, F.col("_v"), True, "med", "mad")
        g = g.join(grouped_quantiles(base, keys, F.abs("_v"), {"p68": 0.68, "abs_med": 0.5}, True), keys)
        g = g.join(base.groupBy(*keys).agg(F.stddev_pop("_v").alias("std")), keys)
    else:
        # window and aggregate share one exchange
        g = with_median(base, keys, F.col("_v"), "_m").groupBy(*keys).agg(
            F.first("_m").alias("med"), F.percentile(F.abs(F.col("_v") - F.col("_m")), 0.5).alias("mad"), F.percentile(F.abs("_v"), 0.68).alias("p68"),
            F.percentile(F.abs("_v"), 0.5).alias("abs_med"), F.stddev_pop("_v").alias("std"))
    s = F.col("mad") * MAD_SIGMA
    return g.select(
        *keys, "med",
        F.when(s > 0, s).otherwise(F.col("std")).alias("sigma"),
        F.when(F.col("p68") > 0, F.col("p68")).otherwise(F.col("abs_med")).alias("abs_scale"),
    )


def with_scales(df: DataFrame, keys: Sequence[str], value: Column, cond: Column) -> DataFrame:
    """Attach med, sigma and abs_scale of ``robust_scales`` over the group's rows where ``cond`` holds, and ``_scaled``: the group has a key and
    such rows. Windows over the keys alone, for groups that fit a task."""
    w = W.partitionBy(*keys)
    known = F.max(cond).over(w)
    for k in keys:
        known = known & F.col(k).isNotNull()
    d = df.withColumns({"_scaled": known, "_v": F.when(cond, finite_or_null(value))}).withColumn("med", F.median("_v").over(w))
    d = d.withColumns({"_mad": F.percentile(F.abs(F.col("_v") - F.col("med")), 0.5).over(w), "_p68": F.percentile(F.abs("_v"), 0.68).over(w), "_abs": F.percentile(F.abs("_v"), 0.5).over(w),
                       "_std": F.stddev_pop("_v").over(w)})
    s = F.col("_mad") * MAD_SIGMA
    return d.withColumns({"sigma": F.when(s > 0, s).otherwise(F.col("_std")), "abs_scale": F.when(F.col("_p68") > 0, F.col("_p68")).otherwise(F.col("_abs"))}).drop("_v", "_mad", "_p68", "_abs", "_std")


def subtractive_scale(scales: DataFrame, min_abs: float = 1e-12, min_snr: float = 3.0) -> DataFrame:
    """Pick |median| when it stands above the noise, else the larger robust scale; label the source."""
    floor = F.greatest(F.lit(min_abs), F.col("sigma"), F.col("abs_scale"))
    need = F.when(F.col("sigma") > 0, F.greatest(F.lit(min_abs), F.lit(min_snr) * F.col("sigma"))).otherwise(F.lit(min_abs))
    trusted = F.abs("med") >= need
    return scales.withColumns({
        "scale": F.when(F.col("med").isNull(), F.lit(None)).when(trusted, F.abs("med")).otherwise(floor),
        "scale_source": F.when(F.col("med").isNull(), "no_finite_fit_flux")
                         .when(trusted, "auto_median_abs").otherwise("auto_robust_abs"),
    })


def clipped_rms(df: DataFrame, keys: Sequence[str], value: Column, sigma: float = 5.0,
                iterations: int = 2, hot: bool = False) -> DataFrame:
    """RMS about the median after ``iterations`` rounds of MAD clipping."""
    keys = list(keys)
    rows = df.select(*keys, finite_or_null(value).alias("_v")).where(F.col("_v").isNotNull())
    for i in range(iterations):
        rows = with_median(rows, keys, F.col("_v"), "_m", hot)
        rows = with_median(rows, keys, F.abs(F.col("_v") - F.col("_m")), "_d", hot)
        keep = (F.col("_d") <= 0) | (F.abs(F.col("_v") - F.col("_m")) <= F.lit(sigma * MAD_SIGMA) * F.col("_d"))
        rows = rows.where(keep).select(*keys, "_v")
    rows = with_median(rows, keys, F.col("_v"), "_m", hot)
    return rows.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(F.col("_v") - F.col("_m"), 2))).alias("clipped_rms"), F.count("_v").alias("n_kept"))


def clipped_line_fit(df: DataFrame, keys: Sequence[str], x: Column, y: Column,
                     sigma: float = 5.0, rounds: int = 3, hot: bool = False) -> DataFrame:
    """Least-squares line with MAD-clipped residuals; returns slope, intercept, sigma and n per key."""
    keys = list(keys)
    rows = df.select(*keys, x.alias("_x"), y.alias("_y")).where(finite(F.col("_x")) & finite(F.col("_y")))
    kept = rows
    for i in range(rounds):
        fit = kept.groupBy(*keys).agg(
            F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))
        joined = rows.join(fit, keys) if keys else rows.transform(with_row, fit)
        res = joined.withColumn("_r", F.col("_y") - F.col("slope") * F.col("_x") - F.col("intercept"))
        if i == rounds - 1:
            break
        scale = median_mad(res, keys, F.col("_r"), hot, "_rm", "_rd")
        res = res.join(scale, keys) if keys else res.transform(with_row, scale)
        kept = res.where((F.col("_rd") <= 0) | (F.abs(F.col("_r") - F.col("_rm")) <= sigma * MAD_SIGMA * F.col("_rd")))
        kept = kept.select(*keys, "_x", "_y")
    return fit
