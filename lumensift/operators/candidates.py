"""Metrics of many candidates at fixed ephemerides in two apertures: cadences meet the events near them, not every ephemeris."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import cadence, robust, skew

#: Prefix of each aperture's columns.
PREFIXES = {"SML": "small", "PRI": "primary"}
SHAPE = ("even_depth", "odd_depth", "even_n_in", "odd_n_in", "even_odd_depth_delta", "even_odd_sigma_delta")
DISAGREEMENT = 0.02


def _usable(period: Column, t0: Column, duration: Column) -> Column:
    return F.coalesce(robust.finite(period) & robust.finite(t0) & robust.finite(duration) & (period > 0) & (duration > 0), F.lit(False))


def ephemerides(candidates: DataFrame, apertures: Sequence[str]) -> DataFrame:
    """review_id, tic, scope, aperture, period_d, t0_bjd, duration_min: each candidate's anchor in all apertures, its own ephemeris in each."""
    one = lambda scope, a, prefix: F.struct(F.lit(scope).alias("scope"), F.lit(a).alias("aperture"), *[F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("period_d", "t0_bjd", "duration_min")])
    every = F.explode(F.array(*[one("anchor", a, "") for a in apertures], *[one("own", a, f"{PREFIXES[a]}_") for a in apertures]))
    e = candidates.select("review_id", "tic", every.alias("e")).select("review_id", "tic", "e.*")
    return e.where(_usable(F.col("period_d"), F.col("t0_bjd"), F.col("duration_min")))


def near_events(eph: DataFrame, curves: DataFrame, out_limit_min: float = 90.0) -> DataFrame:
    """The cadences within ``out_limit_min`` (or half a duration) of an event, once for each ephemeris, beside its event.

    Events inside a target's span become intervals, and both sides are filed under (target, aperture, time bucket), an interval under each bucket
    that it touches; so the join holds the rows near events alone, and a target with very many cadences is as many keys as buckets.
    """
    span = curves.groupBy("tic", "aperture").agg(F.min("time").alias("_lo"), F.max("time").alias("_hi"))
    reach = F.greatest(F.lit(out_limit_min), F.col("duration_min") / 2) / K.MIN_PER_DAY
    e = eph.withColumn("_reach", reach).join(span, ["tic", "aperture"])
    first, last = (F.floor((F.col(c) + s * F.col("_reach") - F.col("t0_bjd")) / F.col("period_d")).cast("bigint") for c, s in (("_lo", -1), ("_hi", 1)))
    e = e.withColumn("_k", F.explode(F.sequence(first, last + 1)))
    mid = F.col("t0_bjd") + F.col("_k") * F.col("period_d")
    width = 2 * out_limit_min / K.MIN_PER_DAY
    bucket = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    e = e.where((mid + F.col("_reach") >= F.col("_lo")) & (mid - F.col("_reach") <= F.col("_hi")))
    e = e.withColumn("_bucket", F.explode(F.sequence(bucket(mid - F.col("_reach")), bucket(mid + F.col("_reach")))))
    c = curves.select("tic", "aperture", "time", "y", bucket(F.col("time")).alias("_bucket"))
    j = e.join(c, ["tic", "aperture", "_bucket"])
    near = F.abs(E.phase_minutes("time", "period_d", "t0_bjd")) <= F.col("_reach") * K.MIN_PER_DAY
    return j.where(near & (E.event_number("time", "period_d", "t0_bjd") == F.col("_k"))).drop("_lo", "_hi", "_bucket", "_reach")


def event_metrics(near: DataFrame, keys: Sequence[str], out_limit_min: float = 90.0, min_out: int = 10, hot: bool = False) -> DataFrame:
    """n_in, depth, snr and the depths of even and odd events per ``keys``, all from one pass over the rows near events.

    Depths are against the median of the rows outside (beyond the duration and 20 minutes, within ``out_limit_min``) and null with fewer than
    ``min_out`` of those.
    """
    keys = list(keys)
    minutes = F.abs(E.phase_minutes("time", "period_d", "t0_bjd"))
    inside = minutes <= F.col("duration_min") / 2
    outside = (minutes > F.greatest(F.col("duration_min"), F.lit(20.0))) & (minutes < out_limit_min)
    odd = F.pmod(F.col("_k"), F.lit(2)) == 1
    at = lambda cond: F.when(cond, F.col("y"))
    d = near.withColumns({"_in": at(inside), "_ev": at(inside & ~odd), "_od": at(inside & odd), "_out": at(outside)})
    d = robust.with_median(d, keys, F.col("_out"), "_om", hot).withColumn("_dev", F.abs(F.col("_out") - F.col("_om")))
    cols = {"_mi": "_in", "_me": "_ev", "_mo": "_od", "_md": "_dev"}
    plain = [F.count("_in").alias("n_in"), F.count("_out").alias("n_out"), F.count("_ev").alias("even_n_in"), F.count("_od").alias("odd_n_in"), F.first("_om", True).alias("_om")]
    if hot:
        g = d.groupBy(*keys).agg(*plain)
        for name, c in cols.items():
            g = g.join(robust.grouped_quantiles(d, keys, F.col(c), {name: 0.5}, True), keys, "left")
    else:
        g = d.groupBy(*keys).agg(*plain, *[F.percentile(c, 0.5).alias(name) for name, c in cols.items()])
    enough = F.col("n_out") >= min_out
    sigma = F.when(F.col("_md") > 0, K.MAD_SIGMA * F.col("_md"))
    depth = lambda m: F.when(enough, F.col("_om") - F.col(m))
    g = g.withColumns({"depth": depth("_mi"), "even_depth": depth("_me"), "odd_depth": depth("_mo"), "_sigma": F.when(enough, sigma)})
    delta = F.col("odd_depth") - F.col("even_depth")
    error = F.col("_sigma") * F.sqrt(1.0 / F.nullif("even_n_in", F.lit(0)) + 1.0 / F.nullif("odd_n_in", F.lit(0)))
    return g.select(*keys, "n_in", "depth", (F.col("depth") / F.col("_sigma") * F.sqrt("n_in")).alias("snr"), "even_depth", "odd_depth", "even_n_in", "odd_n_in", delta.alias("even_odd_depth_delta"),
                    (F.abs(delta) / error).alias("even_odd_sigma_delta"))


def two_aperture_metrics(candidates: DataFrame, cadences: DataFrame, apertures: Sequence[str] = ("SML", "PRI"), out_limit_min: float = 90.0, min_out: int = 10,
                         trend: tuple[float, int, int] = (0.25, 50, 10), hot: bool = False) -> DataFrame:
    """One row per candidate: metadata_status and, per aperture, metrics at the anchor's and at its own ephemeris, and across apertures.

    ``candidates``: review_id (once each), tic, period_d, t0_bjd, duration_min (the anchor) and <prefix>_period_d, _t0_bjd, _duration_min for each
    aperture's own peak. Status: no_ephemeris (the anchor isn't finite), missing_target (no usable cadence), ok. Counts are 0 and the rest null
    where an ephemeris or an aperture is missing. ``trend`` holds bin width, least rows and least rows of a bin of the slow trend.
    """
    skew.assert_unique(candidates, ["review_id"], "candidates")
    curves = cadence.normalise(cadence.good_cadences(cadences), hot)
    near = near_events(ephemerides(candidates, apertures), curves, out_limit_min)
    m = event_metrics(near, ["review_id", "scope", "aperture"], out_limit_min, min_out, hot)
    slow = cadence.trend_amplitude(cadences, *trend, hot=hot).select("tic", "aperture", "trend_ptp")
    pick = lambda scope, a, c: F.max(F.when((F.col("scope") == scope) & (F.col("aperture") == a), F.col(c)))
    wide = []
    for a in apertures:
        x = PREFIXES[a]
        wide += [pick("own", a, c).alias(f"{x}_own_{c}") for c in SHAPE] + [pick("anchor", a, c).alias(f"{x}_anchor_{c}") for c in ("depth", "snr", "n_in", *SHAPE)]
    m = m.groupBy("review_id").agg(*wide)
    slow = slow.groupBy("tic").agg(*[F.max(F.when(F.col("aperture") == a, F.col("trend_ptp"))).alias(f"{PREFIXES[a]}_trend_ptp") for a in apertures])
    known = curves.select("tic").distinct().withColumn("_known", F.lit(True))
    base = candidates.select("review_id", "tic", F.col("period_d").alias("anchor_period_d"), F.col("t0_bjd").alias("anchor_t0_bjd"), F.col("duration_min").alias("anchor_duration_min"),
                             *[F.col(f"{PREFIXES[a]}_period_d") for a in apertures])
    d = base.join(m, "review_id", "left").join(known, "tic", "left").join(slow, "tic", "left")
    ok = _usable(F.col("anchor_period_d"), F.col("anchor_t0_bjd"), F.col("anchor_duration_min"))
    d = d.withColumn("metadata_status", F.when(~ok, "no_ephemeris").when(F.col("_known").isNull(), "missing_target").otherwise("ok"))
    counts = [c for c in d.columns if c.endswith("_n_in")]
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    s, p = (PREFIXES[a] for a in apertures)
    delta = F.when((F.col(f"{s}_period_d") > 0) & robust.finite(F.col(f"{p}_period_d")), F.abs(F.col(f"{p}_period_d") - F.col(f"{s}_period_d")) / F.nullif(f"{s}_period_d", F.lit(0.0)))
    d = d.withColumn("aperture_period_rel_delta", delta)
    return d.withColumns({"aperture_depth_ratio": F.col(f"{p}_anchor_depth") / F.nullif(f"{s}_anchor_depth", F.lit(0.0)),
                          "aperture_disagreement": F.coalesce(F.col("aperture_period_rel_delta") > DISAGREEMENT, F.lit(False))}).drop("_known")


def enrich(candidates: DataFrame, cadences: DataFrame, apertures: Sequence[str] = ("SML", "PRI"), **settings) -> DataFrame:
    """The candidates with their metrics, one to one: columns that the metrics have, too, are replaced, rows neither lost nor doubled."""
    m = two_aperture_metrics(candidates, cadences, apertures, **settings)
    new = [c for c in m.columns if c not in ("review_id", "tic", *[f"{PREFIXES[a]}_period_d" for a in apertures])]
    return candidates.drop(*new).join(m.select("review_id", *new), "review_id")


def enrichment_summary(enriched: DataFrame) -> DataFrame:
    """metadata_status, n, n_targets; passed says whether all candidates are ok."""
    g = enriched.groupBy("metadata_status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tic").alias("n_targets"))
    return g.withColumn("passed", F.col("metadata_status") == "ok")
