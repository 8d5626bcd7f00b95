"""Joins on cadence and time: reconciliation, exact and nearest alignment, product comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import ordered, robust
from lumensift.operators.cadence import CURVE, good


def reconcile(expected: DataFrame, quality: DataFrame, keys: Sequence[str], check: str = "orbitid") -> DataFrame:
    """Exact full-outer reconciliation; every key gets a state: both, left_only, right_only or a disagreement."""
    keys = list(keys)
    l = expected.select(*keys, F.col(check).alias("_lc")).withColumn("_l", F.lit(True))
    r = quality.select(*keys, F.col(check).alias("_rc"), *[c for c in quality.columns if c not in (*keys, check)]).withColumn("_r", F.lit(True))
    j = l.join(r, keys, "full_outer")
    state = (F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
             .when(~F.col("_lc").eqNullSafe(F.col("_rc")), f"{check}_mismatch").otherwise("both"))
    return j.withColumn("state", state).withColumn(check, F.coalesce("_lc", "_rc")).drop("_l", "_r", "_lc", "_rc")


def require_reconciled(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise with up to five examples when any key is not in both tables."""
    bad = states.where("state <> 'both'").select(*keys, "state").orderBy(*keys).limit(5).collect()
    if bad:
        raise ValueError(f"cadence tables disagree: {[tuple(b) for b in bad]}")
    return states


def align_by_cadence(requested: DataFrame, raw: DataFrame, max_error_s: float = 2.0) -> DataFrame:
    """Every requested cadence against the raw one: state ok, missing or time_error."""
    j = requested.join(raw.select("tic", "cadenceno", F.col("time").alias("raw_time"), F.col("flux").alias("raw_flux")), ["tic", "cadenceno"], "left")
    dt = F.abs(F.col("time") - F.col("raw_time")) * K.SEC_PER_DAY
    return j.withColumns({"dt_s": dt, "state": F.when(F.col("raw_time").isNull(), "missing").when(dt > max_error_s, "time_error").otherwise("ok")})


def nearest_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_cols: Sequence[str], right_cols: Sequence[str],
                 max_error_s: float | None = None, hot: bool = False) -> DataFrame:
    """As-of join to the nearest right row (earlier one on ties) without an inequality join.

    Both sides are stacked and ordered by time once; each left row reads the last right row before it and the
    first after it, which is linear in the rows instead of their product.
    """
    keys = list(keys)
    payload = F.struct(F.col("time").alias("rt"), *[F.col(c) for c in right_cols])
    r = right.select(*keys, "time", F.lit(0).alias("_side"), payload.alias("_r"))
    l = left.select(*keys, "time", F.lit(1).alias("_side"), F.struct(*left_cols).alias("_l"))
    both = r.unionByName(l, allowMissingColumns=True)
    d = ordered.with_neighbours(both, keys, ["time", "_side"], F.col("_r"), "_b", "_a", hot).where("_side = 1")
    db, da = F.col("time") - F.col("_b.rt"), F.col("_a.rt") - F.col("time")
    pick = F.when(F.col("_a").isNull() | (db <= da), F.col("_b")).otherwise(F.col("_a"))
    d = d.withColumn("_p", pick)
    out = d.select(*keys, "time", "_l.*", F.col("_p.rt").alias("match_time"), *[F.col(f"_p.{c}").alias(f"match_{c}") for c in right_cols])
    out = out.withColumn("dt_s", F.abs(F.col("time") - F.col("match_time")) * K.SEC_PER_DAY)
    return out if max_error_s is None else out.withColumn("within", F.coalesce(F.col("dt_s") <= max_error_s, F.lit(False)))


def matched_products(current: DataFrame, reference: DataFrame, period: Column, t0: Column, duration: Column,
                     max_dt_s: float = 1.0, hot: bool = False) -> DataFrame:
    """Two products on common cadences: in/out levels, scatter and depth of each, per curve."""
    a = current.where(good()).select(*CURVE, "cadenceno", "time", F.col("flux").alias("cur"))
    b = reference.where(good()).select(*CURVE, "cadenceno", F.col("time").alias("rtime"), F.col("flux").alias("ref"))
    j = a.join(b, [*CURVE, "cadenceno"]).where(F.abs(F.col("time") - F.col("rtime")) * K.SEC_PER_DAY <= max_dt_s)
    inside = F.abs(E.phase_minutes(F.col("time"), period, t0)) <= duration / 2
    out = j.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("n_common"), F.count_if(inside).alias("n_in"))
    for c in ("cur", "ref"):
        q = robust.grouped_quantiles(j, CURVE, F.when(inside, F.col(c)), {f"{c}_in": 0.5}, hot)
        m = robust.median_mad(j, CURVE, F.when(~inside, F.col(c)), hot, f"{c}_out", f"{c}_mad")
        out = out.join(q, CURVE).join(m, CURVE).withColumn(f"{c}_depth", (F.col(f"{c}_out") - F.col(f"{c}_in")) / F.nullif(f"{c}_out", F.lit(0.0)))
    return out


def compare_trees(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("tic", "orbitid", "aperture"), min_overlap: int = 20, hot: bool = False) -> DataFrame:
    """Per target, orbit and aperture: common good rows, correlation of normalised flux, difference MAD and negative share."""
    keys = list(keys)
    ga, gb = a.where(good()), b.where(good())
    j = ga.select(*keys, "cadenceno", F.col("flux").alias("fa")).join(gb.select(*keys, "cadenceno", F.col("flux").alias("fb")), [*keys, "cadenceno"])
    j = robust.with_median(robust.with_median(j, keys, F.col("fa"), "_ma", hot), keys, F.col("fb"), "_mb", hot)
    j = j.withColumns({"na": F.col("fa") / F.nullif("_ma", F.lit(0.0)), "nb": F.col("fb") / F.nullif("_mb", F.lit(0.0))}).withColumn("_d", F.col("na") - F.col("nb"))
    mad = robust.median_mad(j, keys, F.col("_d"), hot, "_dm", "_dd")
    s = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_common"), F.corr("na", "nb").alias("_c"), F.avg((F.col("fa") < 0).cast("double")).alias("negative_fraction"))
    every = ga.select(*keys).distinct().withColumn("_ia", F.lit(True)).join(gb.select(*keys).distinct().withColumn("_ib", F.lit(True)), keys, "full_outer")
    out = every.join(s, keys, "left").join(mad, keys, "left")
    status = (F.when(F.col("_ia").isNull() | F.col("_ib").isNull(), "missing_path")
              .when(F.coalesce("n_common", F.lit(0)) < min_overlap, "insufficient_overlap").otherwise("ok"))
    ok = status == "ok"
    return out.select(*keys, F.coalesce("n_common", F.lit(0)).alias("n_common"), status.alias("status"), F.when(ok, F.col("_c")).alias("correlation"),
                      F.when(ok, K.MAD_SIGMA * F.col("_dd") * 1e6).alias("difference_mad_ppm"), F.when(ok, F.col("negative_fraction")).alias("negative_fraction"))


def product_parity(a: DataFrame, b: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("tic", "aperture", "cadenceno")) -> DataFrame:
    """Full-outer difference per target: missing and extra rows, and whether each column agrees (NULL equals NULL)."""
    keys = list(keys)
    l = a.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns]).withColumn("_l", F.lit(True))
    r = b.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns]).withColumn("_r", F.lit(True))
    j = l.join(r, keys, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.groupBy("tic").agg(F.count_if(F.col("_r").isNull()).alias("n_missing"), F.count_if(F.col("_l").isNull()).alias("n_extra"),
                                *[F.count_if(both & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(f"{c}_mismatches") for c in columns])
