"""Cadence-level cleaning, normalisation, noise, bins and folded statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import ordered, robust
from lumensift.operators.robust import finite, finite_or_null

CURVE = ["tic", "aperture"]
ORDER = ["time", "cadenceno"]


def fill_defaults(df: DataFrame, hot: bool = False) -> DataFrame:
    """Absent quality and orbit become 0, an absent cadence number the position in time."""
    d = ordered.with_row_index(df.withColumn("_tie", F.coalesce("cadenceno", F.lit(-1))), CURVE, ["time", "_tie"], "_ri", hot)
    return d.withColumns({
        "quality": F.coalesce("quality", F.lit(0)), "orbitid": F.coalesce("orbitid", F.lit(0)),
        "cadenceno": F.coalesce("cadenceno", F.col("_ri"))}).drop("_ri", "_tie")


def good(quality="quality", flux="flux", time="time") -> Column:
    """Quality zero with finite flux and time."""
    return (F.col(quality) == 0) & finite(F.col(flux)) & finite(F.col(time))


def good_cadences(df: DataFrame) -> DataFrame:
    return df.where(good())


def bits_clear(quality="quality", drop_bits: int = 0xFFFFFFFF) -> Column:
    """None of ``drop_bits`` is set."""
    return F.col(quality).cast("bigint").bitwiseAND(F.lit(drop_bits).cast("bigint")) == 0


def trim_orbit_edges(df: DataFrame, trim_d: float, min_cadences: int = K.MIN_CADENCES, hot: bool = False) -> DataFrame:
    """Drop rows near each orbit's ends; the curve stays whole when too few rows would survive."""
    per_orbit = [*CURVE, "orbitid"]
    d = robust.with_agg(df, per_orbit, hot, _lo=F.min("time"), _hi=F.max("time"), _n=F.count(F.lit(1)))
    inside = (F.col("_n") < 2) | ((F.col("time") >= F.col("_lo") + trim_d) & (F.col("time") <= F.col("_hi") - trim_d))
    d = robust.with_count(d.withColumn("_in", inside), CURVE, F.col("_in"), "_left", hot)
    return d.where(F.col("_in") | (F.col("_left") < min_cadences)).drop("_lo", "_hi", "_n", "_in", "_left")


def normalise(df: DataFrame, hot: bool = False, out: str = "y") -> DataFrame:
    """Flux over its curve median; NULL where the median is zero or missing (status all_nan)."""
    d = robust.with_median(df, CURVE, F.col("flux"), "_med", hot)
    return d.withColumn(out, F.when(F.col("_med") != 0, F.col("flux") / F.nullif("_med", F.lit(0.0)))).drop("_med")


def clip_upper(df: DataFrame, sigma: float = K.UPPER_CLIP_SIGMA, min_cadences: int = K.MIN_CADENCES,
               hot: bool = False, value: str = "y") -> DataFrame:
    """Remove bright outliers around 1; dips stay; skipped when MAD is 0 or too few rows survive."""
    d = robust.with_median(df, CURVE, F.abs(F.col(value) - 1), "_mad", hot)
    keep = (F.col(value) - 1) <= F.lit(sigma * K.MAD_SIGMA) * F.col("_mad")
    d = robust.with_count(d.withColumn("_keep", keep), CURVE, F.col("_keep"), "_left", hot)
    skip = (F.col("_mad") <= 0) | F.col("_mad").isNull() | (F.col("_left") < min_cadences)
    return d.where(F.col("_keep") | skip).drop("_mad", "_keep", "_left")


def clean(df: DataFrame, min_cadences: int = K.MIN_CADENCES, trim_d: float = 0.0,
          sigma: float = K.UPPER_CLIP_SIGMA, hot: bool = False) -> DataFrame:
    """Good mask, optional edge trim, median normalisation, upper clip; one exchange when not hot."""
    d = good_cadences(df)
    if trim_d > 0:
        d = trim_orbit_edges(d, trim_d, min_cadences, hot)
    return clip_upper(normalise(d, hot), sigma, min_cadences, hot)


def cleaning_counts(df: DataFrame, trim_d: float, sigma: float = K.UPPER_CLIP_SIGMA,
                    min_cadences: int = K.MIN_CADENCES, hot: bool = False) -> DataFrame:
    """Rows lost to quality, edge trim and clip per curve; they add up to the total."""
    count = lambda d, n: d.groupBy(*CURVE).agg(F.count(F.lit(1)).alias(n))
    q = good_cadences(df)
    t = trim_orbit_edges(q, trim_d, min_cadences, hot) if trim_d > 0 else q
    c = clip_upper(normalise(t, hot), sigma, min_cadences, hot)
    out = count(df, "n_cad_total")
    for d, n in ((q, "n_cad_quality"), (t, "_n_trim"), (c, "n_cad_kept")):
        out = out.join(count(d, n), CURVE, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*CURVE, "n_cad_total", z("n_cad_quality").alias("n_cad_quality"),
                      (z("n_cad_quality") - z("_n_trim")).alias("n_cad_edge_trimmed"),
                      (z("_n_trim") - z("n_cad_kept")).alias("n_cad_sigma_clipped"), z("n_cad_kept").alias("n_cad_kept"))


def point_to_point_noise(df: DataFrame, value: str = "flux", bin_minutes: float = 30.0, cadence_s: float = 200.0,
                         min_points: int = 30, scale: float = K.MAD_SIGMA, hot: bool = False,
                         keys: Sequence[str] = tuple(CURVE)) -> DataFrame:
    """Binned white-noise precision from successive differences; NULL below ``min_points``."""
    keys = list(keys)
    per_bin = max(1, round(bin_minutes * 60.0 / cadence_s))
    d = ordered.with_previous(df, keys, ORDER, {"_pv": F.col(value)}, hot)
    d = d.withColumn("_d", F.abs(F.col(value) - F.col("_pv")))
    out = _medians(d, keys, {"_md": F.col("_d")}, hot, F.count(F.lit(1)).alias("n_points"))
    noise = F.lit(scale) * F.col("_md") / F.sqrt(F.lit(2.0)) / F.sqrt(F.lit(float(per_bin)))
    return out.select(*keys, "n_points", F.when(F.col("n_points") >= min_points, noise).alias("precision"))


def adjacent_bin_noise(df: DataFrame, value: str = "flux", n_adjacent: int = 9, fraction: Column | None = None,
                       min_points: int = 30, scale: float = 1.48, hot: bool = False) -> DataFrame:
    """Mean of each run of adjacent cadences, then the MAD of successive differences."""
    d = ordered.with_row_index(df, CURVE, ORDER, "_ri", hot)
    binned = d.groupBy(*CURVE, F.floor(F.col("_ri") / n_adjacent).alias("time")).agg(
        F.avg(value).alias("_b"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n_adjacent)
    binned = binned.withColumn("cadenceno", F.col("time"))
    step = ordered.with_previous(binned, CURVE, ["time"], {"_pb": F.col("_b")}, hot, chunk_d=1000.0)
    out = robust.grouped_quantiles(step, CURVE, F.abs(F.col("_b") - F.col("_pb")), {"_md": 0.5}, hot)
    n = df.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("n_points"))
    return n.join(out, CURVE, "left").select(
        *CURVE, "n_points", F.when(F.col("n_points") >= min_points, F.lit(scale) * F.col("_md") / F.sqrt(F.lit(2.0))).alias("precision"))


def broadcast_mad_error(df: DataFrame, value: str = "flux", hot: bool = False) -> DataFrame:
    """Per-curve 1.4826 MAD on good rows, NULL elsewhere."""
    v = F.when(good(), F.col(value))
    d = robust.with_median(df.withColumn("_v", v), CURVE, F.col("_v"), "_m", hot)
    d = robust.with_median(d, CURVE, F.abs(F.col("_v") - F.col("_m")), "_d", hot)
    return d.withColumn("flux_err", F.when(good(), F.lit(K.MAD_SIGMA) * F.col("_d"))).drop("_v", "_m", "_d")


def synthesise_raw_flux(raw: DataFrame, hot: bool = False) -> DataFrame:
    """Missing raw flux from the magnitude, its error from the per-orbit MAD, flagged."""
    key = ["tic", "orbit"]
    d = raw.withColumns({"flux_was_synthesized": F.col("raw_flux").isNull(),
                         "flux": F.coalesce("raw_flux", F.pow(F.lit(10.0), -0.4 * F.col("raw_mag")))})
    syn = F.when(F.col("flux_was_synthesized"), F.col("flux"))
    d = robust.with_median(d.withColumn("_s", syn), key, F.col("_s"), "_m", hot)
    d = robust.with_median(d, key, F.abs(F.col("_s") - F.col("_m")), "_d", hot)
    return d.withColumn("flux_err", F.when(F.col("flux_was_synthesized"), F.lit(K.MAD_SIGMA) * F.col("_d"))).drop("_s", "_m", "_d")


def time_bins(df: DataFrame, bin_minutes: float, value: str = "flux", hot: bool = False) -> DataFrame:
    """Tumbling bins from each curve's first good row: median time and value."""
    g = good_cadences(df)
    g = robust.with_agg(g, CURVE, hot, _t0=F.min("time"))
    g = g.withColumn("bin", F.floor((F.col("time") - F.col("_t0")) / F.lit(bin_minutes / K.MIN_PER_DAY)))
    return g.groupBy(*CURVE, "bin").agg(F.percentile("time", 0.5).alias("time_med"),
                                        F.percentile(value, 0.5).alias("value_med"), F.count(F.lit(1)).alias("n"))


def folded_bins(df: DataFrame, period: Column, t0: Column, n_bins: int, window: float,
                value: str = "y", keys: Sequence[str] = tuple(CURVE), min_count: int = 2) -> DataFrame:
    """Median and its error per phase bin inside +-``window`` cycles."""
    keys = list(keys)
    d = df.withColumn("_ph", E.orbital_phase(F.col("time"), period, t0)).where(F.abs("_ph") < window)
    d = d.withColumn("bin", F.least(F.floor((F.col("_ph") + window) / F.lit(2 * window / n_bins)), F.lit(n_bins - 1).cast("bigint")))
    by = [*keys, "bin"]
    mm = robust.median_mad(d, by, F.col(value))
    n = d.groupBy(*by).agg(F.count(value).alias("n"))
    return mm.join(n, by).where(F.col("n") >= min_count).select(
        *by, "n", F.col("med").alias("value_med"), (F.lit(K.MAD_SIGMA) * F.col("mad") / F.sqrt("n")).alias("value_err"))


def trend_amplitude(df: DataFrame, bin_d: float = 0.25, min_rows: int = 50, min_in_bin: int = 10,
                    value: str = "flux", hot: bool = False) -> DataFrame:
    """p90 - p10 of centred bin medians, a measure of slow drifts; NULL with fewer than three bins."""
    g = robust.with_agg(good_cadences(df), CURVE, hot, _t0=F.min("time"), _n=F.count(F.lit(1))).where(F.col("_n") >= min_rows)
    b = g.groupBy(*CURVE, F.floor((F.col("time") - F.col("_t0")) / bin_d).alias("bin")).agg(
        F.percentile(value, 0.5).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_in_bin)
    out = b.groupBy(*CURVE).agg(F.count("m").alias("n_bins"),
                                (F.percentile("m", 0.9) - F.percentile("m", 0.1)).alias("_a"))
    return out.select(*CURVE, "n_bins", F.when(F.col("n_bins") >= 3, F.col("_a")).alias("trend_ptp"))


def _fold_class(minutes: Column, duration: Column, out_limit_min: float) -> tuple[Column, Column]:
    inside = F.abs(minutes) <= duration / 2
    outside = (F.abs(minutes) > F.greatest(duration, F.lit(20.0))) & (F.abs(minutes) < out_limit_min)
    return inside, outside


def _medians(d: DataFrame, keys: list[str], cols: dict[str, Column], hot: bool, *plain: Column) -> DataFrame:
    """Plain aggregates plus medians per key, in one pass unless hot."""
    if not hot:
        return d.groupBy(*keys).agg(*plain, *[F.percentile(finite_or_null(c), 0.5).alias(n) for n, c in cols.items()])
    out = d.groupBy(*keys).agg(*plain)
    for n, c in cols.items():
        out = out.join(robust.grouped_quantiles(d, keys, c, {n: 0.5}, True), keys, "left")
    return out


def depth_at_ephemeris(df: DataFrame, period: Column, t0: Column, duration: Column, value: str = "y",
                       keys: Sequence[str] = tuple(CURVE), hot: bool = False, min_out: int = 10,
                       out_limit_min: float = 90.0) -> DataFrame:
    """Depth against the adjacent out-of-event level and its S/N per curve."""
    keys = list(keys)
    inside, outside = _fold_class(E.phase_minutes(F.col("time"), period, t0), duration, out_limit_min)
    d = df.withColumns({"_in": F.when(inside, F.col(value)), "_out": F.when(outside, F.col(value))})
    d = robust.with_median(d, keys, F.col("_out"), "_om", hot)
    d = d.withColumn("_dev", F.abs(F.col("_out") - F.col("_om")))
    out = _medians(d, keys, {"_im": F.col("_in"), "_md": F.col("_dev")}, hot, F.count("_in").alias("n_in"),
                   F.count("_out").alias("n_out"), F.first("_om").alias("_om"))
    ok = (F.col("n_in") >= 1) & (F.col("n_out") >= min_out)
    depth = F.col("_om") - F.col("_im")
    sigma = F.lit(K.MAD_SIGMA) * F.col("_md")
    return out.select(*keys, "n_in", F.when(ok, depth).alias("depth"),
                      F.when(ok & (sigma > 0), depth / F.nullif(sigma, F.lit(0.0)) * F.sqrt("n_in")).alias("snr"))


def odd_even_depth(df: DataFrame, period: Column, t0: Column, duration: Column, value: str = "y",
                   keys: Sequence[str] = tuple(CURVE), hot: bool = False, min_out: int = 10,
                   out_limit_min: float = 90.0) -> DataFrame:
    """Depths of even and odd events and the significance of their difference."""
    keys = list(keys)
    inside, outside = _fold_class(E.phase_minutes(F.col("time"), period, t0), duration, out_limit_min)
    odd = F.pmod(E.event_number(F.col("time"), period, t0), F.lit(2)) == 1
    d = df.withColumns({"_ev": F.when(inside & ~odd, F.col(value)), "_od": F.when(inside & odd, F.col(value)),
                        "_out": F.when(outside, F.col(value))})
    d = robust.with_median(d, keys, F.col("_out"), "_om", hot)
    g = _medians(d, keys, {"_md": F.abs(F.col("_out") - F.col("_om")), "_em": F.col("_ev"), "_odm": F.col("_od")}, hot,
                 F.count("_out").alias("_n"), F.first("_om").alias("_om"),
                 F.count("_ev").alias("even_n_in"), F.count("_od").alias("odd_n_in"))
    ok = F.col("_n") >= min_out
    sigma = F.lit(K.MAD_SIGMA) * F.col("_md")
    even, odd_ = F.col("_om") - F.col("_em"), F.col("_om") - F.col("_odm")
    err = F.when((F.col("even_n_in") > 0) & (F.col("odd_n_in") > 0),
                 sigma * F.sqrt(1.0 / F.nullif("even_n_in", F.lit(0)) + 1.0 / F.nullif("odd_n_in", F.lit(0))))
    delta = odd_ - even
    return g.select(*keys, "even_n_in", "odd_n_in", F.when(ok, even).alias("even_depth"), F.when(ok, odd_).alias("odd_depth"),
                    F.when(ok, delta).alias("even_odd_depth_delta"),
                    F.when(ok & (err > 0), F.abs(delta) / F.nullif(err, F.lit(0.0))).alias("even_odd_sigma_delta"))


def centroid_shift(df: DataFrame, period: Column, t0: Column, duration: Column, threshold: float = 3.0,
                   oot_factor: float = 3.0, min_in: int = 5, min_out: int = 20, max_sigma: float = 1.0,
                   hot: bool = False) -> DataFrame:
    """In-event minus adjacent centroid per target with a status."""
    ph = F.abs(E.phase_minutes(F.col("time"), period, t0))
    inside = good("quality", "sap_x") & (ph <= duration / 2)
    outside = good("quality", "sap_x") & (ph > duration / 2) & (ph <= duration / 2 + oot_factor * duration)
    cols = {}
    for a in ("x", "y"):
        cols[f"_{a}i"] = F.when(inside, F.col(f"sap_{a}"))
        cols[f"_{a}o"] = F.when(outside, F.col(f"sap_{a}"))
    g = _medians(df.withColumns(cols), ["tic"], {c: F.col(c) for c in cols}, hot, F.count("_xi").alias("n_in"),
                 F.count("_xo").alias("n_out"), *[F.stddev_pop(f"_{a}o").alias(f"_s{a}") for a in "xy"])
    g = g.withColumns({"dx": F.col("_xi") - F.col("_xo"), "dy": F.col("_yi") - F.col("_yo")})
    shift = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    sigma = F.sqrt((F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy"))) / F.sqrt(F.nullif("n_in", F.lit(0)))
    z = F.when(sigma > 0, shift / F.nullif(sigma, F.lit(0.0)))
    status = (F.when(F.col("n_in") < min_in, "too_few_in").when(F.col("n_out") < min_out, "too_few_out")
              .when(sigma.isNull() | (sigma > max_sigma), "noisy").when(z > threshold, "shifted").otherwise("on_target"))
    return g.select("tic", "n_in", "n_out", "dx", "dy", z.alias("z"), status.alias("status"))


def orbit_normalised(df: DataFrame, hot: bool = False) -> DataFrame:
    """(flux - orbit median) / orbit MAD scale from quality-zero rows, all rows where an orbit has none."""
    key = [*CURVE, "orbitid"]
    d = df.withColumn("_g", F.when(F.col("quality") == 0, F.col("flux")))
    d = robust.with_median(d, key, F.col("_g"), "_mg", hot)
    d = robust.with_median(d, key, F.col("flux"), "_ma", hot)
    d = d.withColumn("_m", F.coalesce("_mg", "_ma"))
    ref = F.when(F.col("_mg").isNull(), F.col("flux")).otherwise(F.col("_g"))
    d = robust.with_median(d.withColumn("_r", F.abs(ref - F.col("_m"))), key, F.col("_r"), "_s", hot)
    scale = F.lit(K.MAD_SIGMA) * F.col("_s")
    return d.withColumns({
        "flux_norm": F.when(scale > 0, (F.col("flux") - F.col("_m")) / F.nullif(scale, F.lit(0.0))),
        "flux_rel": F.when(F.col("_m") != 0, F.col("flux") / F.nullif("_m", F.lit(0.0)) - 1)}).drop("_g", "_mg", "_ma", "_m", "_r", "_s")


def position_features(df: DataFrame, hot: bool = False) -> DataFrame:
    """Relative time, log gap, cadence and orbit positions, orbit boundary and quality flags."""
    d = robust.with_agg(df, CURVE, hot, _t0=F.min("time"), _t1=F.max("time"), _c0=F.min("cadenceno"), _c1=F.max("cadenceno"))
    d = robust.with_agg(d, [*CURVE, "orbitid"], hot, _o0=F.min("time"), _o1=F.max("time"))
    d = ordered.with_previous(d, CURVE, ORDER, {"_pt": F.col("time"), "_po": F.col("orbitid")}, hot)
    unit = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(v) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0))).otherwise(F.lit(0.0))
    return d.withColumns({
        "rel_time": unit("time", "_t0", "_t1"), "log_gap": F.coalesce(F.log1p(F.col("time") - F.col("_pt")), F.lit(0.0)),
        "cadence_pos": unit("cadenceno", "_c0", "_c1"), "orbit_pos": unit("time", "_o0", "_o1"),
        "orbit_boundary": F.coalesce(F.col("orbitid") != F.col("_po"), F.lit(True)), "quality_flag": F.col("quality") != 0,
    }).drop("_t0", "_t1", "_c0", "_c1", "_o0", "_o1", "_pt", "_po")


def gap_interpolated(df: DataFrame, fit: Column, value: str = "flux", out: str = "filled", hot: bool = False) -> DataFrame:
    """Linear interpolation in time between fit rows; edges hold the nearest fit value."""
    point = F.when(fit & finite(F.col(value)), F.struct(F.col("time").alias("t"), F.col(value).alias("v")))
    d = ordered.with_neighbours(df, CURVE, ORDER, point, "_b", "_a", hot)
    dt = F.col("_a.t") - F.col("_b.t")
    mix = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("time") - F.col("_b.t")) / F.nullif(dt, F.lit(0.0))
    return d.withColumn(out, F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v"))
                        .when(dt == 0, F.col("_b.v")).otherwise(mix)).drop("_a", "_b")


def odd_window_rows(df: DataFrame, window_d: float, hot: bool = False) -> DataFrame:
    """Rows per curve that span ``window_d`` at the median spacing: at least 5 and odd."""
    d = ordered.with_previous(df, CURVE, ORDER, {"_pt": F.col("time")}, hot)
    step = F.col("time") - F.col("_pt")
    q = robust.grouped_quantiles(d, CURVE, F.when(step > 0, step), {"_dt": 0.5}, hot)
    w = F.greatest(F.lit(5).cast("bigint"), F.ceil(F.lit(window_d) / F.nullif("_dt", F.lit(0.0))))
    return q.select(*CURVE, F.coalesce(w + (1 - w % 2), F.lit(5).cast("bigint")).alias("width"))


def first_per_cadence(df: DataFrame) -> DataFrame:
    """One row per target, aperture and cadence: the earliest; aggregates map-side."""
    rest = [c for c in df.columns if c not in (*CURVE, "cadenceno")]
    return df.groupBy(*CURVE, "cadenceno").agg(F.min_by(F.struct(*rest), F.struct("time", *[c for c in rest if c != "time"])).alias("_r")) \
        .select(*CURVE, "cadenceno", "_r.*")
