"""Queries on the cadence view: cleaning, noise, bins, folds and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import exprs as E
from lumensift.operators import cadence as C, ordered, robust, skew
from lumensift.plans.registry import query, r
from lumensift.plans.views import CADENCES, RAW
from lumensift.sources import binding as B

#: survivors needed per driver curve (they hold some 67 rows, a survey curve thousands)
MIN_ROWS = 20

GOOD = "g AS (SELECT * FROM cadences WHERE quality = 0 AND isfinite(flux) AND isfinite(time))"
NORM = GOOD + """,
nm AS (SELECT *, median(flux) OVER (PARTITION BY tic, aperture) AS med FROM g),
y AS (SELECT *, CASE WHEN med <> 0 THEN flux / med END AS y FROM nm)"""
CLIP = NORM + f""",
md AS (SELECT *, median(abs(y - 1)) OVER (PARTITION BY tic, aperture) AS mad FROM y),
kp AS (SELECT *, (y - 1) <= (5.0::DOUBLE * 1.4826::DOUBLE) * mad AS keep FROM md),
cn AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY tic, aperture) AS n_left FROM kp),
clean AS (SELECT * FROM cn WHERE keep OR mad <= 0 OR mad IS NULL OR n_left < {MIN_ROWS})"""

PERIOD, T0, DUR = 1.7, 0.4, 200.0


def curves(spark, d):
    """The cadence view and whether some curve is too large for one task."""
    c = B.cadences(spark, d)
    return c, skew.has_hot_group(B.table(spark, d, "events"), ["user_id"])


@query("good_cadences", CADENCES, GOOD, sql="""
SELECT tic, aperture, count(*) AS n_good, CAST(sum(cadenceno) AS BIGINT) AS cad_sum, round(min(time), 6) AS t_first, round(max(time), 6) AS t_last
FROM g GROUP BY ALL""")
def good_cadences(spark, d):
    return C.good_cadences(B.cadences(spark, d)).groupBy("tic", "aperture").agg(
        F.count(F.lit(1)).alias("n_good"), F.sum("cadenceno").alias("cad_sum"),
        r(F.min("time")).alias("t_first"), r(F.max("time")).alias("t_last"))


@query("bitmask_filter", CADENCES, sql="""
SELECT orbitid, aperture, count(*) FILTER (WHERE ((cadenceno % 16) & 5) = 0) AS n_clear, count(*) AS n_all FROM cadences GROUP BY ALL""")
def bitmask_filter(spark, d):
    c = B.cadences(spark, d).withColumn("bits", F.col("cadenceno") % 16)
    return c.groupBy("orbitid", "aperture").agg(F.count_if(C.bits_clear("bits", 5)).alias("n_clear"), F.count(F.lit(1)).alias("n_all"))


@query("orbit_edge_trim", CADENCES, GOOD, sql=f"""
, o AS (SELECT *, min(time) OVER w AS lo, max(time) OVER w AS hi, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY tic, aperture, orbitid)),
i AS (SELECT *, n < 2 OR (time >= lo + 0.5::DOUBLE AND time <= hi - 0.5::DOUBLE) AS ins FROM o),
k AS (SELECT *, count(*) FILTER (WHERE ins) OVER (PARTITION BY tic, aperture) AS n_left FROM i)
SELECT tic, aperture, orbitid, count(*) AS n, CAST(sum(cadenceno) AS BIGINT) AS cad_sum FROM k WHERE ins OR n_left < {MIN_ROWS} GROUP BY ALL""")
def orbit_edge_trim(spark, d):
    c, hot = curves(spark, d)
    return C.trim_orbit_edges(C.good_cadences(c), 0.5, MIN_ROWS, hot).groupBy("tic", "aperture", "orbitid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cadenceno").alias("cad_sum"))


@query("median_normalised", CADENCES, NORM, sql="SELECT tic, aperture, cadenceno, round(y, 9) AS y FROM y")
def median_normalised(spark, d):
    c, hot = curves(spark, d)
    return C.normalise(C.good_cadences(c), hot).select("tic", "aperture", "cadenceno", r("y", 9).alias("y"))


@query("upper_sigma_clip", CADENCES, CLIP, sql="SELECT tic, aperture, cadenceno, round(y, 9) AS y FROM clean")
def upper_sigma_clip(spark, d):
    c, hot = curves(spark, d)
    return C.clean(c, MIN_ROWS, hot=hot).select("tic", "aperture", "cadenceno", r("y", 9).alias("y"))


@query("cleaning_counts", CADENCES, CLIP, sql="""
, a AS (SELECT tic, aperture, count(*) AS n_cad_total FROM cadences GROUP BY ALL),
q AS (SELECT tic, aperture, count(*) AS n_cad_quality FROM g GROUP BY ALL),
z AS (SELECT tic, aperture, count(*) AS n_cad_kept FROM clean GROUP BY ALL)
SELECT a.tic, a.aperture, n_cad_total, coalesce(n_cad_quality, 0) AS n_cad_quality, CAST(0 AS BIGINT) AS n_cad_edge_trimmed,
       coalesce(n_cad_quality, 0) - coalesce(n_cad_kept, 0) AS n_cad_sigma_clipped, coalesce(n_cad_kept, 0) AS n_cad_kept
FROM a LEFT JOIN q USING (tic, aperture) LEFT JOIN z USING (tic, aperture)""")
def cleaning_counts(spark, d):
    c, hot = curves(spark, d)
    return C.cleaning_counts(c, 0.0, min_cadences=MIN_ROWS, hot=hot)


@query("noisiest_targets", CADENCES, CLIP, sql="""
, l AS (SELECT *, lag(y) OVER (PARTITION BY tic, aperture ORDER BY time, cadenceno) AS py FROM clean),
p AS (SELECT tic, aperture, count(*) AS n_points, median(abs(y - py)) AS md FROM l GROUP BY ALL),
s AS (SELECT tic, aperture, n_points, CASE WHEN n_points >= 30 THEN round(1.4826 * md / sqrt(2) / 3.0, 9) END AS precision FROM p)
SELECT * FROM s ORDER BY precision DESC NULLS LAST, tic, aperture LIMIT 20""")
def noisiest_targets(spark, d):
    """The minimum slice: scan, mask, normalise, clip, noise, top 20."""
    c, hot = curves(spark, d)
    p = C.point_to_point_noise(C.clean(c, MIN_ROWS, hot=hot), "y", hot=hot)
    return p.withColumn("precision", r("precision", 9)).orderBy(F.desc_nulls_last("precision"), "tic", "aperture").limit(20)


@query("point_to_point_noise", CADENCES, GOOD, sql="""
, l AS (SELECT *, lag(flux) OVER (PARTITION BY tic, aperture ORDER BY time, cadenceno) AS pf FROM g)
SELECT tic, aperture, count(*) AS n_points, CASE WHEN count(*) >= 30 THEN round(1.4826 * median(abs(flux - pf)) / sqrt(2) / 3.0, 9) END AS precision
FROM l GROUP BY ALL""")
def point_to_point_noise(spark, d):
    c, hot = curves(spark, d)
    return C.point_to_point_noise(C.good_cadences(c), hot=hot).withColumn("precision", r("precision", 9))


@query("adjacent_bin_noise", CADENCES, GOOD, sql="""
, n AS (SELECT *, row_number() OVER (PARTITION BY tic, aperture ORDER BY time, cadenceno) - 1 AS ri FROM g),
b AS (SELECT tic, aperture, CAST(floor(ri / 3) AS BIGINT) AS b, avg(flux) AS m FROM n GROUP BY ALL HAVING count(*) = 3),
l AS (SELECT *, lag(m) OVER (PARTITION BY tic, aperture ORDER BY b) AS pm FROM b),
q AS (SELECT tic, aperture, median(abs(m - pm)) AS md FROM l GROUP BY ALL),
k AS (SELECT tic, aperture, count(*) AS n_points FROM g GROUP BY ALL)
SELECT tic, aperture, n_points, CASE WHEN n_points >= 30 THEN round(1.48 * md / sqrt(2), 9) END AS precision FROM k LEFT JOIN q USING (tic, aperture)""")
def adjacent_bin_noise(spark, d):
    c, hot = curves(spark, d)
    return C.adjacent_bin_noise(C.good_cadences(c), n_adjacent=3, hot=hot).withColumn("precision", r("precision", 9))


@query("mad_error", CADENCES, NORM, sql="""
, e AS (SELECT *, 1.4826 * median(abs(flux - med)) OVER (PARTITION BY tic, aperture) AS err FROM nm)
SELECT c.tic, c.aperture, c.cadenceno, round(e.err, 9) AS flux_err FROM cadences c LEFT JOIN e ON e.tic = c.tic AND e.aperture = c.aperture AND e.cadenceno = c.cadenceno""")
def mad_error(spark, d):
    c, hot = curves(spark, d)
    return C.broadcast_mad_error(c, hot=hot).select("tic", "aperture", "cadenceno", r("flux_err", 9).alias("flux_err"))


@query("synthesised_raw_flux", RAW, sql="""
, f AS (SELECT *, raw_flux IS NULL AS flux_was_synthesized, coalesce(raw_flux, pow(10, -0.4 * raw_mag)) AS flux FROM raw_cadences),
m AS (SELECT *, median(CASE WHEN flux_was_synthesized THEN flux END) OVER (PARTITION BY tic, orbit) AS m FROM f),
e AS (SELECT *, median(CASE WHEN flux_was_synthesized THEN abs(flux - m) END) OVER (PARTITION BY tic, orbit) AS e FROM m)
SELECT tic, orbit, cadenceno, flux_was_synthesized, round(flux, 9) AS flux, CASE WHEN flux_was_synthesized THEN round(1.4826 * e, 12) END AS flux_err FROM e""")
def synthesised_raw_flux(spark, d):
    raw = B.raw_cadences(spark, d)
    hot = skew.has_hot_group(raw, ["tic", "orbit"])
    return C.synthesise_raw_flux(raw, hot).select("tic", "orbit", "cadenceno", "flux_was_synthesized",
                                                  r("flux", 9).alias("flux"), r("flux_err", 12).alias("flux_err"))


@query("curve_scan_defaults", CADENCES, sql="""
, v AS (SELECT tic, aperture, time, flux, CASE WHEN tic % 2 = 0 THEN cadenceno END AS cadenceno, CASE WHEN tic % 3 = 0 THEN quality END AS quality FROM cadences),
n AS (SELECT *, row_number() OVER (PARTITION BY tic, aperture ORDER BY time, coalesce(cadenceno, -1)) - 1 AS ri FROM v)
SELECT tic, aperture, round(time, 9) AS time, coalesce(cadenceno, ri) AS cadenceno, CAST(coalesce(quality, 0) AS INTEGER) AS quality, CAST(0 AS INTEGER) AS orbitid FROM n""")
def curve_scan_defaults(spark, d):
    c, hot = curves(spark, d)
    v = c.select("tic", "aperture", "time", "flux", F.when(F.col("tic") % 2 == 0, F.col("cadenceno")).alias("cadenceno"),
                 F.when(F.col("tic") % 3 == 0, F.col("quality")).alias("quality"), F.lit(None).cast("int").alias("orbitid"))
    return C.fill_defaults(v, hot).select("tic", "aperture", r("time", 9).alias("time"), "cadenceno", "quality", "orbitid")


@query("time_bins", CADENCES, GOOD, sql="""
, t AS (SELECT *, min(time) OVER (PARTITION BY tic, aperture) AS t0 FROM g)
SELECT tic, aperture, CAST(floor((time - t0) / (720.0::DOUBLE / 1440.0)) AS BIGINT) AS bin, round(median(time), 8) AS time_med, round(median(flux), 8) AS value_med, count(*) AS n
FROM t GROUP BY ALL""")
def time_bins(spark, d):
    c, hot = curves(spark, d)
    return C.time_bins(c, 720.0, hot=hot).select("tic", "aperture", "bin", r("time_med", 8).alias("time_med"), r("value_med", 8).alias("value_med"), "n")


FOLD_SQL = f"((time - {T0}::DOUBLE + {PERIOD}::DOUBLE / 2) - {PERIOD}::DOUBLE * floor((time - {T0}::DOUBLE + {PERIOD}::DOUBLE / 2) / {PERIOD}::DOUBLE) - {PERIOD}::DOUBLE / 2)"


@query("folded_bins", CADENCES, NORM, sql=f"""
, p AS (SELECT *, {FOLD_SQL} / {PERIOD}::DOUBLE AS ph FROM y),
b AS (SELECT *, least(CAST(floor((ph + 0.25::DOUBLE) / 0.05::DOUBLE) AS BIGINT), 9) AS bin FROM p WHERE abs(ph) < 0.25),
m AS (SELECT *, median(y) OVER (PARTITION BY tic, aperture, bin) AS med FROM (SELECT tic, aperture, bin, y FROM b))
SELECT tic, aperture, bin, count(*) AS n, round(any_value(med), 8) AS value_med, round(1.4826 * median(abs(y - med)) / sqrt(count(*)), 8) AS value_err
FROM m GROUP BY ALL HAVING count(*) >= 2""")
def folded_bins(spark, d):
    c, hot = curves(spark, d)
    f = C.folded_bins(C.normalise(C.good_cadences(c), hot), F.lit(PERIOD), F.lit(T0), 10, 0.25)
    return f.select("tic", "aperture", "bin", "n", r("value_med", 8).alias("value_med"), r("value_err", 8).alias("value_err"))


@query("trend_amplitude", CADENCES, GOOD, sql="""
, t AS (SELECT *, min(time) OVER w AS t0, count(*) OVER w AS nn FROM g WINDOW w AS (PARTITION BY tic, aperture)),
b AS (SELECT tic, aperture, floor((time - t0) / 5.0::DOUBLE) AS b, median(flux) AS m FROM t WHERE nn >= 30 GROUP BY ALL HAVING count(*) >= 5)
SELECT tic, aperture, count(*) AS n_bins, CASE WHEN count(*) >= 3 THEN round(quantile_cont(m, 0.9) - quantile_cont(m, 0.1), 8) END AS trend_ptp FROM b GROUP BY ALL""")
def trend_amplitude(spark, d):
    c, hot = curves(spark, d)
    return C.trend_amplitude(c, 5.0, 30, 5, hot=hot).select("tic", "aperture", "n_bins", r("trend_ptp", 8).alias("trend_ptp"))


@query("depth_at_ephemeris", CADENCES, NORM, sql=f"""
, p AS (SELECT *, abs({FOLD_SQL} * 1440.0::DOUBLE) AS ph FROM y),
c AS (SELECT tic, aperture, CASE WHEN ph <= {DUR / 2} THEN y END AS yi, CASE WHEN ph > {DUR} AND ph < 900 THEN y END AS yo FROM p),
m AS (SELECT *, median(yo) OVER (PARTITION BY tic, aperture) AS om FROM c),
a AS (SELECT tic, aperture, count(yi) AS n_in, count(yo) AS n_out, any_value(om) AS om, median(yi) AS im, 1.4826 * median(abs(yo - om)) AS s FROM m GROUP BY ALL)
SELECT tic, aperture, n_in, CASE WHEN n_in >= 1 AND n_out >= 10 THEN round(om - im, 8) END AS depth,
       CASE WHEN n_in >= 1 AND n_out >= 10 AND s > 0 THEN round((om - im) / s * sqrt(n_in), 6) END AS snr FROM a""")
def depth_at_ephemeris(spark, d):
    c, hot = curves(spark, d)
    y = C.normalise(C.good_cadences(c), hot)
    # the driver cadence is hours apart, so the fold is stretched tenfold: 90 minutes become 900
    out = C.depth_at_ephemeris(y, F.lit(PERIOD), F.lit(T0), F.lit(DUR), hot=hot, out_limit_min=900.0)
    return out.select("tic", "aperture", "n_in", r("depth", 8).alias("depth"), r("snr").alias("snr"))


@query("odd_even_depth", CADENCES, NORM, sql=f"""
, p AS (SELECT *, abs({FOLD_SQL} * 1440.0::DOUBLE) AS ph, CAST(round_even((time - {T0}::DOUBLE) / {PERIOD}::DOUBLE, 0) AS BIGINT) AS ev FROM y),
c AS (SELECT tic, aperture, CASE WHEN ph <= {DUR / 2} AND ev % 2 = 0 THEN y END AS ye, CASE WHEN ph <= {DUR / 2} AND ev % 2 <> 0 THEN y END AS yd,
      CASE WHEN ph > {DUR} AND ph < 900 THEN y END AS yo FROM p),
m AS (SELECT *, median(yo) OVER (PARTITION BY tic, aperture) AS om FROM c),
a AS (SELECT tic, aperture, count(ye) AS ne, count(yd) AS nd, count(yo) AS n_out, any_value(om) AS om, median(ye) AS em, median(yd) AS dm, 1.4826 * median(abs(yo - om)) AS s FROM m GROUP BY ALL)
SELECT tic, aperture, ne AS even_n_in, nd AS odd_n_in, CASE WHEN n_out >= 10 THEN round(om - em, 8) END AS even_depth, CASE WHEN n_out >= 10 THEN round(om - dm, 8) END AS odd_depth,
  CASE WHEN n_out >= 10 THEN round((om - dm) - (om - em), 8) END AS even_odd_depth_delta,
  CASE WHEN n_out >= 10 AND ne > 0 AND nd > 0 AND s > 0 THEN round(abs((om - dm) - (om - em)) / (s * sqrt(1 / ne + 1 / nd)), 6) END AS even_odd_sigma_delta FROM a""")
def odd_even_depth(spark, d):
    c, hot = curves(spark, d)
    y = C.normalise(C.good_cadences(c), hot)
    out = C.odd_even_depth(y, F.lit(PERIOD), F.lit(T0), F.lit(DUR), hot=hot, out_limit_min=900.0)
    return out.select("tic", "aperture", "even_n_in", "odd_n_in", *[r(k, 8).alias(k) for k in ("even_depth", "odd_depth", "even_odd_depth_delta")],
                      r("even_odd_sigma_delta").alias("even_odd_sigma_delta"))


@query("centroid_shift", CADENCES, sql=f"""
, p AS (SELECT *, abs({FOLD_SQL} * 1440.0::DOUBLE) AS ph FROM cadences WHERE aperture = 'SML'),
c AS (SELECT tic, CASE WHEN quality = 0 AND ph <= 200 THEN sap_x END AS xi, CASE WHEN quality = 0 AND ph <= 200 THEN sap_y END AS yi,
   CASE WHEN quality = 0 AND ph > 200 AND ph <= 1400 THEN sap_x END AS xo, CASE WHEN quality = 0 AND ph > 200 AND ph <= 1400 THEN sap_y END AS yo FROM p),
a AS (SELECT tic, count(xi) AS n_in, count(xo) AS n_out, median(xi) - median(xo) AS dx, median(yi) - median(yo) AS dy, stddev_pop(xo) AS sx, stddev_pop(yo) AS sy FROM c GROUP BY ALL),
s AS (SELECT *, sqrt(sx * sx + sy * sy) / sqrt(nullif(n_in, 0)) AS sg FROM a)
SELECT tic, n_in, n_out, round(dx, 8) AS dx, round(dy, 8) AS dy, CASE WHEN sg > 0 THEN round(sqrt(dx * dx + dy * dy) / sg, 6) END AS z,
  CASE WHEN n_in < 5 THEN 'too_few_in' WHEN n_out < 20 THEN 'too_few_out' WHEN sg IS NULL OR sg > 1 THEN 'noisy'
       WHEN sqrt(dx * dx + dy * dy) / sg > 3 THEN 'shifted' ELSE 'on_target' END AS status FROM s""")
def centroid_shift(spark, d):
    c = B.cadences(spark, d).where(F.col("aperture") == "SML")
    out = C.centroid_shift(c, F.lit(PERIOD), F.lit(T0), F.lit(400.0), hot=skew.has_hot_group(c, ["tic"]))
    return out.select("tic", "n_in", "n_out", r("dx", 8).alias("dx"), r("dy", 8).alias("dy"), r("z").alias("z"), "status")


@query("gap_segments", CADENCES, sql="""
, l AS (SELECT *, lag(time) OVER (PARTITION BY tic, aperture ORDER BY time, cadenceno) AS pt FROM cadences),
s AS (SELECT *, sum(CASE WHEN time - pt > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY tic, aperture ORDER BY time, cadenceno ROWS UNBOUNDED PRECEDING) AS seg FROM l)
SELECT tic, aperture, CAST(seg AS BIGINT) AS segment, count(*) AS n, round(max(time) - min(time), 8) AS span_d FROM s GROUP BY ALL""")
def gap_segments(spark, d):
    c, hot = curves(spark, d)
    return ordered.with_gap_segments(c, C.CURVE, "time", "cadenceno", 0.5, hot=hot).groupBy("tic", "aperture", "segment").agg(
        F.count(F.lit(1)).alias("n"), r(F.max("time") - F.min("time"), 8).alias("span_d"))


@query("running_median", CADENCES, GOOD, sql="""
SELECT tic, aperture, cadenceno, round(median(flux) OVER (PARTITION BY tic, aperture ORDER BY time, cadenceno ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) AS smooth FROM g""")
def running_median(spark, d):
    c, hot = curves(spark, d)
    return ordered.with_running_median(C.good_cadences(c), C.CURVE, C.ORDER, F.col("flux"), "smooth", 3, hot=hot) \
        .select("tic", "aperture", "cadenceno", r("smooth", 9).alias("smooth"))


@query("gap_interpolation", CADENCES, sql="""
, f AS (SELECT *, CASE WHEN quality = 0 AND cadenceno % 5 <> 0 THEN time END AS ft, CASE WHEN quality = 0 AND cadenceno % 5 <> 0 THEN flux END AS ff FROM cadences),
n AS (SELECT tic, aperture, cadenceno, time,
   last_value(ft IGNORE NULLS) OVER b AS bt, last_value(ff IGNORE NULLS) OVER b AS bv, first_value(ft IGNORE NULLS) OVER a AS ta, first_value(ff IGNORE NULLS) OVER a AS av
   FROM f WINDOW b AS (PARTITION BY tic, aperture ORDER BY time, cadenceno ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 a AS (PARTITION BY tic, aperture ORDER BY time, cadenceno ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT tic, aperture, cadenceno, round(CASE WHEN bt IS NULL THEN av WHEN ta IS NULL THEN bv WHEN ta = bt THEN bv ELSE bv + (av - bv) * (time - bt) / (ta - bt) END, 8) AS filled FROM n""")
def gap_interpolation(spark, d):
    c, hot = curves(spark, d)
    fit = (F.col("quality") == 0) & (F.col("cadenceno") % 5 != 0)
    return C.gap_interpolated(c, fit, hot=hot).select("tic", "aperture", "cadenceno", r("filled", 8).alias("filled"))


@query("odd_window_rows", CADENCES, sql="""
, l AS (SELECT *, time - lag(time) OVER (PARTITION BY tic, aperture ORDER BY time, cadenceno) AS dt FROM cadences),
m AS (SELECT tic, aperture, median(CASE WHEN dt > 0 THEN dt END) AS dt FROM l GROUP BY ALL),
w AS (SELECT tic, aperture, greatest(5, CAST(ceil(4.0::DOUBLE / nullif(dt, 0)) AS BIGINT)) AS w FROM m)
SELECT tic, aperture, coalesce(w + (1 - w % 2), 5) AS width FROM w""")
def odd_window_rows(spark, d):
    c, hot = curves(spark, d)
    return C.odd_window_rows(c, 4.0, hot)


@query("position_features", CADENCES, sql="""
, a AS (SELECT *, min(time) OVER c AS t0, max(time) OVER c AS t1, min(cadenceno) OVER c AS c0, max(cadenceno) OVER c AS c1,
   min(time) OVER o AS o0, max(time) OVER o AS o1, lag(time) OVER l AS pt, lag(orbitid) OVER l AS po FROM cadences
   WINDOW c AS (PARTITION BY tic, aperture), o AS (PARTITION BY tic, aperture, orbitid), l AS (PARTITION BY tic, aperture ORDER BY time, cadenceno))
SELECT tic, aperture, cadenceno, round(CASE WHEN t1 > t0 THEN (time - t0) / (t1 - t0) ELSE 0 END, 9) AS rel_time,
  round(coalesce(ln(1 + (time - pt)), 0), 8) AS log_gap, round(CASE WHEN c1 > c0 THEN (cadenceno - c0) / (c1 - c0) ELSE 0 END, 9) AS cadence_pos,
  round(CASE WHEN o1 > o0 THEN (time - o0) / (o1 - o0) ELSE 0 END, 9) AS orbit_pos, coalesce(orbitid <> po, true) AS orbit_boundary, quality <> 0 AS quality_flag FROM a""")
def position_features(spark, d):
    c, hot = curves(spark, d)
    return C.position_features(c, hot).select("tic", "aperture", "cadenceno", r("rel_time", 9).alias("rel_time"), r("log_gap", 8).alias("log_gap"),
                                              r("cadence_pos", 9).alias("cadence_pos"), r("orbit_pos", 9).alias("orbit_pos"), "orbit_boundary", "quality_flag")


@query("orbit_normalised", CADENCES, sql="""
, m AS (SELECT *, median(CASE WHEN quality = 0 THEN flux END) OVER w AS mg, median(flux) OVER w AS ma FROM cadences WINDOW w AS (PARTITION BY tic, aperture, orbitid)),
n AS (SELECT *, coalesce(mg, ma) AS m FROM m),
s AS (SELECT *, 1.4826 * median(CASE WHEN mg IS NULL OR quality = 0 THEN abs(flux - m) END) OVER (PARTITION BY tic, aperture, orbitid) AS s FROM n)
SELECT tic, aperture, cadenceno, CASE WHEN s > 0 THEN round((flux - m) / s, 8) END AS flux_norm, CASE WHEN m <> 0 THEN round(flux / m - 1, 8) END AS flux_rel FROM s""")
def orbit_normalised(spark, d):
    c, hot = curves(spark, d)
    return C.orbit_normalised(c, hot).select("tic", "aperture", "cadenceno", r("flux_norm", 8).alias("flux_norm"), r("flux_rel", 8).alias("flux_rel"))


@query("first_per_cadence", CADENCES, sql="""
, u AS (SELECT tic, aperture, cadenceno % 4000 AS cadenceno, time, flux FROM cadences),
n AS (SELECT *, row_number() OVER (PARTITION BY tic, aperture, cadenceno ORDER BY time, flux) AS rn FROM u)
SELECT tic, aperture, cadenceno, round(time, 9) AS time, round(flux, 9) AS flux FROM n WHERE rn = 1""")
def first_per_cadence(spark, d):
    u = B.cadences(spark, d).select("tic", "aperture", (F.col("cadenceno") % 4000).alias("cadenceno"), "time", "flux")
    return C.first_per_cadence(u).select("tic", "aperture", "cadenceno", r("time", 9).alias("time"), r("flux", 9).alias("flux"))


@query("robust_scales", CADENCES, GOOD, sql="""
, m AS (SELECT *, median(flux) OVER (PARTITION BY tic, aperture) AS med FROM g),
a AS (SELECT tic, aperture, any_value(med) AS med, 1.4826 * median(abs(flux - med)) AS s, quantile_cont(abs(flux), 0.68) AS p68, stddev_pop(flux) AS sd, median(abs(flux)) AS am FROM m GROUP BY ALL),
z AS (SELECT tic, aperture, med, CASE WHEN s > 0 THEN s ELSE sd END AS sigma, CASE WHEN p68 > 0 THEN p68 ELSE am END AS abs_scale FROM a)
SELECT tic, aperture, round(med, 8) AS med, round(sigma, 8) AS sigma, round(abs_scale, 8) AS abs_scale,
  round(CASE WHEN abs(med) >= greatest(1e-12, 3 * sigma) THEN abs(med) ELSE greatest(1e-12, sigma, abs_scale) END, 8) AS scale,
  CASE WHEN abs(med) >= greatest(1e-12, 3 * sigma) THEN 'auto_median_abs' ELSE 'auto_robust_abs' END AS scale_source FROM z""")
def robust_scales(spark, d):
    c, hot = curves(spark, d)
    s = robust.subtractive_scale(robust.robust_scales(C.good_cadences(c), C.CURVE, F.col("flux"), hot))
    return s.select("tic", "aperture", *[r(k, 8).alias(k) for k in ("med", "sigma", "abs_scale", "scale")], "scale_source")


@query("clipped_rms", CADENCES, GOOD, sql="""
, a1 AS (SELECT *, median(flux) OVER w AS m FROM g WINDOW w AS (PARTITION BY tic, aperture)), b1 AS (SELECT *, median(abs(flux - m)) OVER (PARTITION BY tic, aperture) AS dv FROM a1),
k1 AS (SELECT tic, aperture, flux FROM b1 WHERE dv <= 0 OR abs(flux - m) <= 2.0::DOUBLE * 1.4826::DOUBLE * dv),
a2 AS (SELECT *, median(flux) OVER (PARTITION BY tic, aperture) AS m FROM k1), b2 AS (SELECT *, median(abs(flux - m)) OVER (PARTITION BY tic, aperture) AS dv FROM a2),
k2 AS (SELECT tic, aperture, flux FROM b2 WHERE dv <= 0 OR abs(flux - m) <= 2.0::DOUBLE * 1.4826::DOUBLE * dv),
a3 AS (SELECT *, median(flux) OVER (PARTITION BY tic, aperture) AS m FROM k2)
SELECT tic, aperture, round(sqrt(avg(pow(flux - m, 2))), 8) AS clipped_rms, count(*) AS n_kept FROM a3 GROUP BY ALL""")
def clipped_rms(spark, d):
    c, hot = curves(spark, d)
    out = robust.clipped_rms(C.good_cadences(c), C.CURVE, F.col("flux"), 2.0, 2, hot)
    return out.withColumn("clipped_rms", r("clipped_rms", 8))


@query("in_event_mask", CADENCES, sql=f"""
SELECT orbitid, aperture, count(*) FILTER (WHERE abs({FOLD_SQL}) <= 100.0::DOUBLE / 1440) AS n_in, count(*) FILTER (WHERE abs({FOLD_SQL}) <= 300.0::DOUBLE / 1440) AS n_wide FROM cadences GROUP BY ALL""")
def in_event_mask(spark, d):
    a = (F.col("time"), F.lit(PERIOD), F.lit(T0), F.lit(200.0))
    return B.cadences(spark, d).groupBy("orbitid", "aperture").agg(
        F.count_if(E.in_window(*a)).alias("n_in"), F.count_if(E.in_wide_window(*a)).alias("n_wide"))


@query("time_zero_normalised", CADENCES, sql="""
, t AS (SELECT tic, aperture, cadenceno, CASE WHEN tic % 2 = 0 THEN time + 2457000 ELSE time END AS time FROM cadences),
m AS (SELECT *, median(time) OVER (PARTITION BY tic, aperture) AS mt FROM t)
SELECT tic, aperture, cadenceno, round(CASE WHEN mt < 1e5 THEN time + 2457000 ELSE time END, 6) AS t_abs, round(CASE WHEN mt > 1e5 THEN time - 2457000 ELSE time END, 6) AS t_rel FROM m""")
def time_zero_normalised(spark, d):
    c, hot = curves(spark, d)
    t = c.select("tic", "aperture", "cadenceno", F.when(F.col("tic") % 2 == 0, F.col("time") + 2457000).otherwise(F.col("time")).alias("time"))
    m = robust.with_median(t, C.CURVE, F.col("time"), "mt", hot)
    return m.select("tic", "aperture", "cadenceno", r(E.absolute_time("time", "mt")).alias("t_abs"), r(E.relative_time("time", "mt")).alias("t_rel"))
