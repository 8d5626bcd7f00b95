"""Queries of candidate metrics in two apertures, recovery of injections, and searches of changed curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.operators import candidates as X, injection_search as R, skew
from lumensift.plans.cadence_queries import NORM
from lumensift.plans.detrend_queries import PH
from lumensift.plans.registry import query, r
from lumensift.plans.search_queries import CFG, FACTORS
from lumensift.plans.views import CADENCES, INJECTIONS, PEAKS, QUEUE
from lumensift.sources import binding as B

#: Driver curves hold one row per half day: events last hours, their surroundings reach 15 hours.
REACH = 900.0
TREND = (5.0, 30, 5)


def candidates(spark, d):
    """The review queue as candidates: durations in hours, own peaks near the anchor, some of them or the anchor missing."""
    k = F.col("review_id")
    q = B.queue(spark, d).select("review_id", "tic", F.when(k % 11 != 0, F.col("period_d")).alias("period_d"), (k % 70 / 10.0).alias("t0_bjd"), (F.col("duration_min") * 10).alias("duration_min"))
    own = lambda c: F.when(k % 7 != 0, c)
    return q.withColumns({"small_period_d": own(F.col("period_d") * 1.001), "small_t0_bjd": own(F.col("t0_bjd") + 0.05), "small_duration_min": own(F.col("duration_min")),
                          "primary_period_d": F.col("period_d") * (1 + k % 5 * 0.01), "primary_t0_bjd": F.col("t0_bjd"), "primary_duration_min": F.col("duration_min") * 2})


SHAPE_SQL = ("even_depth", "odd_depth", "even_n_in", "odd_n_in", "even_odd_depth_delta", "even_odd_sigma_delta")
METRICS = f"""
, cd0 AS (SELECT review_id, tic, CASE WHEN review_id % 11 <> 0 THEN period_d END AS period_d, (review_id % 70 / 10)::DOUBLE AS t0_bjd, duration_min * 10 AS duration_min FROM queue),
cd AS (SELECT *, CASE WHEN review_id % 7 <> 0 THEN period_d * 1.001::DOUBLE END AS small_period_d, period_d * (1 + review_id % 5 * 0.01::DOUBLE) AS primary_period_d FROM cd0),
ep AS (SELECT review_id, tic, 'anchor' AS scope, ap AS aperture, period_d AS p, t0_bjd AS t, duration_min AS du FROM cd, (VALUES ('SML'), ('PRI')) a(ap) WHERE period_d > 0
  UNION ALL SELECT review_id, tic, 'own', 'SML', small_period_d, t0_bjd + 0.05::DOUBLE, duration_min FROM cd WHERE small_period_d > 0
  UNION ALL SELECT review_id, tic, 'own', 'PRI', primary_period_d, t0_bjd, duration_min * 2 FROM cd WHERE primary_period_d > 0),
nr AS (SELECT ep.*, y.y, abs({PH('y.time', 'p', 't')} * 1440.0::DOUBLE) AS m, round_even((y.time - t) / p, 0)::BIGINT % 2 <> 0 AS odd FROM ep JOIN y ON y.tic = ep.tic AND y.aperture = ep.aperture),
nc AS (SELECT review_id, scope, aperture, CASE WHEN m <= du / 2 THEN y END AS yi, CASE WHEN m <= du / 2 AND NOT odd THEN y END AS ye, CASE WHEN m <= du / 2 AND odd THEN y END AS yo, CASE WHEN m > greatest(du, 20) AND m < {REACH} THEN y END AS yx FROM nr),
nm2 AS (SELECT *, median(yx) OVER (PARTITION BY review_id, scope, aperture) AS om FROM nc),
ag AS (SELECT review_id, scope, aperture, count(yi) AS n_in, count(yx) AS n_out, count(ye) AS even_n_in, count(yo) AS odd_n_in, any_value(om) AS om, median(yi) AS mi, median(ye) AS me, median(yo) AS mo, 1.4826 * median(abs(yx - om)) AS s0 FROM nm2 GROUP BY ALL),
mt AS (SELECT *, CASE WHEN n_out >= 10 THEN om - mi END AS depth, CASE WHEN n_out >= 10 THEN om - me END AS even_depth, CASE WHEN n_out >= 10 THEN om - mo END AS odd_depth, CASE WHEN n_out >= 10 AND s0 > 0 THEN s0 END AS s FROM ag),
ms AS (SELECT *, depth / s * sqrt(n_in) AS snr, odd_depth - even_depth AS even_odd_depth_delta, abs(odd_depth - even_depth) / (s * sqrt(1.0::DOUBLE / nullif(even_n_in, 0) + 1.0::DOUBLE / nullif(odd_n_in, 0))) AS even_odd_sigma_delta FROM mt),
tg AS (SELECT *, min(time) OVER w AS t0, count(*) OVER w AS nn FROM g WINDOW w AS (PARTITION BY tic, aperture)),
tb AS (SELECT tic, aperture, median(flux) AS m FROM tg WHERE nn >= 30 GROUP BY tic, aperture, floor((time - t0) / 5.0::DOUBLE) HAVING count(*) >= 5),
tr AS (SELECT tic, aperture, CASE WHEN count(*) >= 3 THEN quantile_cont(m, 0.9) - quantile_cont(m, 0.1) END AS ptp FROM tb GROUP BY ALL),
kn AS (SELECT DISTINCT tic FROM y),
w AS (SELECT cd.*, CASE WHEN period_d IS NULL THEN 'no_ephemeris' WHEN kn.tic IS NULL THEN 'missing_target' ELSE 'ok' END AS metadata_status,
  {", ".join(f"{'round(' if c[-4:] != 'n_in' else 'coalesce('}{x}{s[0]}.{c}, {'6' if c[-4:] != 'n_in' else '0'}) AS {x}_{s}_{c}" for x in ('small', 'primary') for s in ('own', 'anchor') for c in ((*SHAPE_SQL,) if s == 'own' else ('depth', 'snr', 'n_in', *SHAPE_SQL)))},
  round(ts.ptp, 8) AS small_trend_ptp, round(tp.ptp, 8) AS primary_trend_ptp, round(abs(primary_period_d - small_period_d) / small_period_d, 8) AS aperture_period_rel_delta,
  round(primarya.depth / nullif(smalla.depth, 0), 5) AS aperture_depth_ratio, coalesce(abs(primary_period_d - small_period_d) / small_period_d > 0.02, false) AS aperture_disagreement
  FROM cd LEFT JOIN kn ON kn.tic = cd.tic {" ".join(f"LEFT JOIN ms {x}{s[0]} ON {x}{s[0]}.review_id = cd.review_id AND {x}{s[0]}.scope = '{s}' AND {x}{s[0]}.aperture = '{a}'" for x, a in (('small', 'SML'), ('primary', 'PRI')) for s in ('own', 'anchor'))}
  LEFT JOIN tr ts ON ts.tic = cd.tic AND ts.aperture = 'SML' LEFT JOIN tr tp ON tp.tic = cd.tic AND tp.aperture = 'PRI')"""


def settings(spark, d):
    return {"out_limit_min": REACH, "trend": TREND, "hot": skew.has_hot_group(B.table(spark, d, "events"), ["user_id"])}


def rounded(m):
    digits = {"small_trend_ptp": 8, "primary_trend_ptp": 8, "aperture_period_rel_delta": 8, "aperture_depth_ratio": 5}
    return m.select(*[r(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


DROP = ["anchor_period_d", "anchor_t0_bjd", "anchor_duration_min", "small_period_d", "primary_period_d"]


@query("two_aperture_metrics", CADENCES, QUEUE, NORM, sql=METRICS + """
SELECT * EXCLUDE (period_d, t0_bjd, duration_min, small_period_d, primary_period_d) FROM w""")
def two_aperture_metrics(spark, d):
    return rounded(X.two_aperture_metrics(candidates(spark, d), B.cadences(spark, d), **settings(spark, d)).drop(*DROP))


@query("candidate_enrichment", CADENCES, QUEUE, NORM, sql=METRICS + """
SELECT review_id, tic, 'kept' AS note, round(small_anchor_depth, 6) AS small_anchor_depth, primary_anchor_n_in, metadata_status, aperture_disagreement FROM w""")
def candidate_enrichment(spark, d):
    stale = candidates(spark, d).withColumns({"note": F.lit("kept"), "small_anchor_depth": F.lit(-1.0), "metadata_status": F.lit("stale")})
    e = X.enrich(stale, B.cadences(spark, d), **settings(spark, d))
    return e.select("review_id", "tic", "note", r("small_anchor_depth").alias("small_anchor_depth"), "primary_anchor_n_in", "metadata_status", "aperture_disagreement")


@query("enrichment_summary", CADENCES, QUEUE, NORM, sql=METRICS + """
SELECT metadata_status, count(*) AS n, count(DISTINCT tic) AS n_targets, metadata_status = 'ok' AS passed FROM w GROUP BY ALL""")
def enrichment_summary(spark, d):
    return X.enrichment_summary(X.enrich(candidates(spark, d), B.cadences(spark, d), **settings(spark, d)))


MATCHES = f"""
, mj AS (SELECT p.*, i.truth_period_d AS tp, i.truth_t0_bjd AS tt, greatest(i.truth_duration_min, 20) AS lim FROM peaks p JOIN injections i ON p.injection_id = i.injection_id),
mk AS (SELECT *, abs(period_d - tp) / tp AS rel, {PH('t0_bjd', 'tp', 'tt')} * 1440 AS perr, {PH('t0_bjd', 'least(period_d, tp)', 'tt')} * 1440 AS herr,
  (SELECT min({{'e': abs(period_d / tp - factor) / factor, 'pos': pos, 'f': factor}}) FROM {FACTORS}) AS h FROM mj),
mx AS (SELECT *, rel <= 0.02 AND abs(perr) <= lim AS ex, h.e <= 0.02 AND abs(herr) <= lim AND abs(h.f - 1) >= 1e-8 AS hm FROM mk),
ma AS (SELECT injection_id, aperture, arg_max({{'sde': sde, 'rk': peak_rank, 'p': period_d, 't': t0_bjd, 'rel': rel, 'perr': perr, 'ex': ex}}, {{'sde': sde, 'r': -peak_rank, 'p': -period_d, 't': -t0_bjd}}) AS b, min(peak_rank) FILTER (ex) AS er, min(peak_rank) FILTER (hm) AS hr, arg_min(h.f, {{'r': peak_rank, 'sde': sde, 'f': h.f}}) FILTER (hm) AS hf FROM mx GROUP BY ALL),
mi AS (SELECT injection_id, arg_max({{'a': aperture, 'b': b}}, {{'x': b.ex, 'sde': b.sde, 'o': CASE aperture WHEN 'SML' THEN -1 ELSE -2 END}}) AS c,
  coalesce(string_agg(aperture, ',' ORDER BY aperture DESC) FILTER (b.ex), '') AS apertures_agree, coalesce(string_agg(aperture, ',' ORDER BY aperture DESC) FILTER (er IS NOT NULL), '') AS topn_apertures_agree, coalesce(string_agg(aperture, ',' ORDER BY aperture DESC) FILTER (hr IS NOT NULL), '') AS harmonic_apertures_agree,
  count(*) FILTER (b.ex) AS n_apertures_agree, count(*) FILTER (er IS NOT NULL) AS n_topn_apertures_agree, count(*) FILTER (hr IS NOT NULL) AS n_harmonic_apertures_agree,
  max(er) FILTER (aperture = 'SML') AS topn_rank_sml, max(er) FILTER (aperture = 'PRI') AS topn_rank_pri, max(hr) FILTER (aperture = 'SML') AS harmonic_rank_sml, max(hf) FILTER (aperture = 'PRI') AS harmonic_factor_pri FROM ma GROUP BY injection_id)"""


@query("injection_search", PEAKS, INJECTIONS, sql=MATCHES + """
SELECT i.injection_id, c.a AS rep_aperture, round(c.b.sde, 6) AS sde, c.b.rk AS peak_rank, round(c.b.rel, 8) AS period_rel_err, round(abs(c.b.perr), 3) AS t0_phase_err_min, coalesce(apertures_agree, '') AS apertures_agree, coalesce(topn_apertures_agree, '') AS topn_apertures_agree, coalesce(harmonic_apertures_agree, '') AS harmonic_apertures_agree,
  coalesce(n_apertures_agree, 0) AS n_apertures_agree, coalesce(n_topn_apertures_agree, 0) AS n_topn_apertures_agree, coalesce(n_harmonic_apertures_agree, 0) AS n_harmonic_apertures_agree,
  topn_rank_sml, topn_rank_pri, harmonic_rank_sml, harmonic_factor_pri, CASE WHEN c IS NULL THEN 'bls_missing' WHEN n_apertures_agree > 0 THEN 'bls_recovered' ELSE 'bls_peak_mismatch' END AS recovery_status,
  CASE WHEN c IS NULL THEN 'bls_missing' WHEN n_apertures_agree > 0 THEN 'bls_top1_recovered' WHEN n_topn_apertures_agree > 0 THEN 'bls_topn_recovered' WHEN n_harmonic_apertures_agree > 0 THEN 'bls_topn_harmonic_match' ELSE 'bls_peak_mismatch' END AS topn_recovery_status
FROM injections i LEFT JOIN mi ON mi.injection_id = i.injection_id""")
def injection_search(spark, d):
    x = R.injection_recovery(B.peaks(spark, d), B.injections(spark, d), B.APERTURES)
    return x.select("injection_id", "rep_aperture", r("sde").alias("sde"), "peak_rank", r("period_rel_err", 8).alias("period_rel_err"), r(F.abs("t0_phase_err_min"), 3).alias("t0_phase_err_min"), "apertures_agree", "topn_apertures_agree",
                    "harmonic_apertures_agree", "n_apertures_agree", "n_topn_apertures_agree", "n_harmonic_apertures_agree", F.col("topn_rank_SML").alias("topn_rank_sml"), F.col("topn_rank_PRI").alias("topn_rank_pri"),
                    F.col("harmonic_rank_SML").alias("harmonic_rank_sml"), F.col("harmonic_factor_PRI").alias("harmonic_factor_pri"), "recovery_status", "topn_recovery_status")


@query("changed_curves", CADENCES, sql="""
SELECT tic, aperture, tic % 5 = 0 AS flux_changed, tic % 7 = 0 AS row_lost FROM cadences GROUP BY ALL HAVING tic % 5 = 0 OR (tic % 7 = 0 AND count(*) FILTER (cadenceno % 100 = 3) > 0) OR tic % 9 = 0""")
def changed_curves(spark, d):
    """The curves that a search has to do again: since the last one, a flux changed, a row was lost, or the curve is new."""
    t, now = F.col("tic"), B.cadences(spark, d)
    old = now.where((t % 9 != 0) & ~((t % 7 == 0) & (F.col("cadenceno") % 100 == 3)))
    old = old.withColumn("flux", F.when(t % 5 == 0, F.col("flux") + 1e-12).otherwise(F.col("flux")))
    todo = R.changed(R.curve_fingerprints(now, CFG), R.curve_fingerprints(old.repartition(7), CFG))
    return todo.select("tic", "aperture", (t % 5 == 0).alias("flux_changed"), (t % 7 == 0).alias("row_lost"))
