"""Queries of the periodic search, consolidation and vetting."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import cadence as C, search as S, vet as V
from lumensift.plans.cadence_queries import CLIP, MIN_ROWS, curves
from lumensift.plans.registry import query, r
from lumensift.plans.views import CADENCES, HUMAN_LABELS, INJECTIONS, PEAKS, QUEUE
from lumensift.sources import binding as B

#: Driver curves hold one row per half day, so boxes are hours wide and periods start at a day.
CFG = S.SearchConfig(n_periods=200, p_min_d=1.0, durations_min=(120.0, 240.0, 360.0, 480.0, 600.0), n_peaks=5, min_cadences=MIN_ROWS)
#: The whole grid: as many periods as a curve's length asks for, the next one at most the narrowest box away.
WHOLE = replace(CFG, n_periods=100, max_drift=1.0)
W_D = "(120.0::DOUBLE / 1440.0)"
BOXES = (1, 2, 3, 4, 5)

STATS = CLIP + f""",
q AS (SELECT tic, aperture, time, orbitid, CAST(round_even((y - 1) * 1e9, 0) AS BIGINT) AS yq FROM clean WHERE y IS NOT NULL),
st0 AS (SELECT tic, aperture, count(*) AS n_all, CAST(sum(yq) AS BIGINT) AS s_all, min(time) AS t_min, max(time) - min(time) AS baseline_d, count(DISTINCT orbitid) AS n_orbits FROM q GROUP BY ALL),
st AS (SELECT *, least(0.45::DOUBLE * baseline_d, 15.0::DOUBLE) AS p_max_d,
  CASE WHEN n_all < {MIN_ROWS} THEN 'too_few_cadences' WHEN least(0.45::DOUBLE * baseline_d, 15.0::DOUBLE) <= 1.0 THEN 'degenerate_grid' ELSE 'ok' END AS status FROM st0)"""
GRID = STATS + """,
grid AS (SELECT tic, aperture, t_min, n_all, s_all, i AS period_idx, 1.0::DOUBLE / (1.0::DOUBLE - i * ((1.0::DOUBLE - 1.0::DOUBLE / p_max_d) / 199.0::DOUBLE)) AS period_d
  FROM st, range(200) x(i) WHERE status = 'ok')"""
WHOLE_GRID = STATS + f""",
gn AS (SELECT *, greatest(100, CAST(ceil((1.0::DOUBLE - 1.0::DOUBLE / p_max_d) * baseline_d * p_max_d / {W_D}) AS BIGINT) + 1) AS n_grid FROM st WHERE status = 'ok'),
grid AS (SELECT tic, aperture, t_min, n_all, s_all, i AS period_idx, 1.0::DOUBLE / (1.0::DOUBLE - i * ((1.0::DOUBLE - 1.0::DOUBLE / p_max_d) / (n_grid - 1))) AS period_d
  FROM (SELECT *, unnest(range(n_grid)) AS i FROM gn))"""
FOLDED = f""",
bn AS (SELECT g.tic, g.aperture, g.period_idx, any_value(g.period_d) AS period_d, any_value(t_min) AS t_min, any_value(n_all) AS n_all, any_value(s_all) AS s_all,
   CAST(floor(((q.time - t_min) % g.period_d) / {W_D}) AS BIGINT) AS bin, count(*) AS n, CAST(sum(yq) AS BIGINT) AS s
   FROM q JOIN grid g ON q.tic = g.tic AND q.aperture = g.aperture GROUP BY g.tic, g.aperture, g.period_idx, CAST(floor(((q.time - t_min) % g.period_d) / {W_D}) AS BIGINT)),
wr AS (SELECT *, bin AS pos, 0 AS turn FROM bn UNION ALL SELECT *, bin + CAST(ceil(period_d / {W_D}) AS BIGINT) AS pos, 1 AS turn FROM bn WHERE bin < 4),
wn AS (SELECT *, {", ".join(f"CAST(sum(n) OVER w{k} AS BIGINT) AS n{k}, CAST(sum(s) OVER w{k} AS BIGINT) AS s{k}" for k in BOXES)} FROM wr
   WINDOW {", ".join(f"w{k} AS (PARTITION BY tic, aperture, period_idx ORDER BY pos RANGE BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)" for k in BOXES)}),
bx AS ({" UNION ALL ".join(f"SELECT tic, aperture, period_idx, period_d, t_min, n_all, s_all, bin, {k} AS k, n{k} AS n_in, s{k} AS s_in FROM wn WHERE turn = 0" for k in BOXES)}),
dp AS (SELECT *, ((s_all - s_in) / (n_all - n_in) - s_in / n_in) / 1e9 AS depth FROM bx WHERE n_in < n_all),
pw AS (SELECT *, 0.5::DOUBLE * n_in * depth * depth AS power FROM dp WHERE depth > 0),
sp AS (SELECT *, depth / sqrt(1.0::DOUBLE / n_in + 1.0::DOUBLE / (n_all - n_in)) AS depth_snr, k * 120.0::DOUBLE AS duration_min, t_min + (bin + k / 2) * {W_D} AS t0 FROM pw
   QUALIFY row_number() OVER (PARTITION BY tic, aperture, period_idx ORDER BY power DESC, k, bin) = 1)"""
BINS = GRID + FOLDED
WHOLE_BINS = WHOLE_GRID + FOLDED
SDE = BINS + """,
sm AS (SELECT *, median(power) OVER (PARTITION BY tic, aperture) AS m FROM sp),
sd AS (SELECT *, 1.4826 * median(abs(power - m)) OVER (PARTITION BY tic, aperture) AS dv FROM sm),
ss AS (SELECT *, (power - m) / dv AS sde FROM sd)"""
MASKED = " OR ".join(f"abs(x.period_d - lst[1].period_d * {f}) <= lst[1].period_d * {f} * 0.005::DOUBLE" for f in ("1.0::DOUBLE", "(1.0::DOUBLE / 3.0::DOUBLE)", "0.5::DOUBLE", "2.0::DOUBLE", "3.0::DOUBLE"))
WALK = SDE + f""",
ls AS (SELECT tic, aperture, list({{'period_idx': period_idx, 'period_d': period_d, 'sde': sde, 'depth': depth, 'depth_snr': depth_snr, 'duration_min': duration_min, 't0': t0, 'power': power}} ORDER BY sde DESC, period_idx) AS lst FROM ss GROUP BY ALL),
wk(tic, aperture, peak_rank, p, lst) AS (
  SELECT tic, aperture, 1, lst[1], list_filter(lst, lambda x: NOT ({MASKED})) FROM ls
  UNION ALL
  SELECT tic, aperture, peak_rank + 1, lst[1], list_filter(lst, lambda x: NOT ({MASKED})) FROM wk WHERE peak_rank < 5 AND len(lst) > 0)"""


def rec(*views):
    """Views for an SQL twin that needs WITH RECURSIVE."""
    first, *rest = views
    return ("RECURSIVE " + first.strip(), *rest)


def prepared(spark, d):
    c, hot = curves(spark, d)
    q = S.with_integer_flux(C.clean(c, CFG.min_cadences, 0.0, CFG.sigma_clip, hot))
    return c, q, S.curve_stats(q, CFG), hot


SPEC_OUT = ["tic", "aperture", "period_idx"]


def spec_cols(df, *extra):
    return df.select(*SPEC_OUT, r("period_d", 8).alias("period_d"), r(F.col("power") * 1e6).alias("power_u"), r("depth", 8).alias("depth"),
                     "duration_min", r("t0").alias("t0"), F.col("n_in").cast("bigint").alias("n_in"), *extra)


SPEC_SQL = "SELECT tic, aperture, period_idx, round(period_d, 8) AS period_d, round(power * 1e6, 6) AS power_u, round(depth, 8) AS depth, duration_min, round(t0, 6) AS t0, n_in"


@query("curve_search_stats", CADENCES, STATS, sql="SELECT tic, aperture, n_all, s_all, round(baseline_d, 8) AS baseline_d, n_orbits, round(p_max_d, 8) AS p_max_d, status FROM st")
def curve_search_stats(spark, d):
    _, _, st, _ = prepared(spark, d)
    return st.select("tic", "aperture", "n_all", "s_all", r("baseline_d", 8).alias("baseline_d"), "n_orbits", r("p_max_d", 8).alias("p_max_d"), "status")


@query("period_grid", CADENCES, GRID, sql="SELECT tic, aperture, period_idx, round(period_d, 9) AS period_d FROM grid")
def period_grid(spark, d):
    _, _, st, _ = prepared(spark, d)
    g = st.where("status = 'ok'").withColumn("period_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CFG.n_periods - 1).cast("bigint"))))
    return g.select("tic", "aperture", "period_idx", r(S.grid_period(F.col("period_idx"), F.col("p_max_d"), CFG), 9).alias("period_d"))


@query("box_spectrum", CADENCES, BINS, sql=SPEC_SQL + " FROM sp")
def box_spectrum(spark, d):
    _, q, st, hot = prepared(spark, d)
    return spec_cols(S.spectrum(q, st, CFG, hot))


@query("box_spectrum_binned", CADENCES, WHOLE_BINS, sql=SPEC_SQL + " FROM sp")
def box_spectrum_binned(spark, d):
    """Every curve over the whole grid."""
    _, q, st, hot = prepared(spark, d)
    return spec_cols(S.spectrum_binned(q, st, WHOLE, hot))


@query("spectrum_sde", CADENCES, SDE, sql="SELECT tic, aperture, period_idx, round(sde, 6) AS sde FROM ss")
def spectrum_sde(spark, d):
    _, q, st, hot = prepared(spark, d)
    return S.with_sde(S.spectrum(q, st, CFG, hot)).select("tic", "aperture", "period_idx", r("sde").alias("sde"))


PEAK_SQL = "SELECT tic, aperture, peak_rank, p.period_idx AS period_idx, round(p.period_d, 8) AS period_d, round(p.sde, 6) AS sde, round(p.depth, 8) AS depth, p.duration_min AS duration_min, round(p.t0, 6) AS t0 FROM wk"


def peak_cols(df):
    return df.select("tic", "aperture", "peak_rank", "period_idx", r("period_d", 8).alias("period_d"), r("sde").alias("sde"), r("depth", 8).alias("depth"), "duration_min", r("t0").alias("t0"))


@query("search_peaks", *rec(CADENCES, WALK), sql=PEAK_SQL)
def search_peaks(spark, d):
    _, q, st, hot = prepared(spark, d)
    return peak_cols(S.pick_peaks(S.with_sde(S.spectrum(q, st, CFG, hot)), CFG))


@query("search_peaks_native_fold", *rec(CADENCES, WALK), sql=PEAK_SQL)
def search_peaks_native_fold(spark, d):
    _, q, st, hot = prepared(spark, d)
    return peak_cols(S.pick_peaks_native(S.with_sde(S.spectrum(q, st, CFG, hot)), CFG))


@query("search_with_status", *rec(CADENCES, WALK), sql="""
, rq AS (SELECT DISTINCT tic, aperture FROM cadences)
SELECT rq.tic, rq.aperture, CASE WHEN coalesce(status, 'missing_aperture') = 'ok' AND peak_rank IS NULL THEN 'nan_power' ELSE coalesce(status, 'missing_aperture') END AS status,
  CAST(coalesce(peak_rank, 0) AS INTEGER) AS peak_rank, round(p.period_d, 8) AS period_d
FROM rq LEFT JOIN st ON st.tic = rq.tic AND st.aperture = rq.aperture LEFT JOIN wk ON wk.tic = rq.tic AND wk.aperture = rq.aperture""")
def search_with_status(spark, d):
    c, hot = curves(spark, d)
    return S.search(c, CFG, hot).select("tic", "aperture", "status", "peak_rank", r("period_d", 8).alias("period_d"))


@query("search_quota_walk")
def search_quota_walk(spark, d):
    """Period-bin quotas: at most two peaks from each of three ranges."""
    _, q, st, hot = prepared(spark, d)
    cfg = replace(CFG, period_bin_edges=(1.0, 2.0, 5.0, 14.0), max_peaks_per_bin=2, n_peaks=6)
    return peak_cols(S.pick_peaks(S.with_sde(S.spectrum(q, st, cfg, hot)), cfg))


@query("resume_unfinished_pairs", CADENCES, sql="""
, p AS (SELECT DISTINCT tic, aperture FROM cadences)
SELECT tic, aperture FROM p WHERE tic % 3 <> 0""")
def resume_unfinished_pairs(spark, d):
    pairs = B.cadences(spark, d).select("tic", "aperture").distinct()
    return S.unfinished(pairs, pairs.where(F.col("tic") % 3 == 0))


MATCH = ("(abs(x.period_d - lst[1].period_d) / lst[1].period_d < 0.005 OR abs(x.period_d - lst[1].period_d * 0.5::DOUBLE) / (lst[1].period_d * 0.5::DOUBLE) < 0.005 "
         "OR abs(x.period_d - lst[1].period_d * 2.0::DOUBLE) / (lst[1].period_d * 2.0::DOUBLE) < 0.005) AND "
         "abs((x.t0_bjd - lst[1].t0_bjd + lst[1].period_d / 2) - lst[1].period_d * floor((x.t0_bjd - lst[1].t0_bjd + lst[1].period_d / 2) / lst[1].period_d) - lst[1].period_d / 2) * 1440 <= 5.0")
CLUSTERS = PEAKS + f""",
pk AS (SELECT tic, list({{'period_d': period_d, 't0_bjd': t0_bjd, 'sde': sde, 'aperture': aperture, 'peak_rank': peak_rank}} ORDER BY sde DESC, aperture, peak_rank, period_d, t0_bjd) AS lst
  FROM peaks WHERE sde >= 7 GROUP BY tic),
cl(tic, step, m, lst) AS (
  SELECT tic, 1, list_filter(lst, lambda x, i: i = 1 OR ({MATCH})), list_filter(lst, lambda x, i: i > 1 AND NOT ({MATCH})) FROM pk
  UNION ALL
  SELECT tic, step + 1, list_filter(lst, lambda x, i: i = 1 OR ({MATCH})), list_filter(lst, lambda x, i: i > 1 AND NOT ({MATCH})) FROM cl WHERE len(lst) > 0)"""


@query("consolidated_clusters", *rec(CLUSTERS), sql="""
SELECT tic, round(m[1].period_d, 8) AS period_d, round(m[1].sde, 6) AS sde_max, m[1].aperture AS rep_aperture, m[1].peak_rank AS rep_peak_rank, len(m) AS n_members,
  CAST(len(list_distinct(list_transform(m, lambda x: x.aperture))) AS INTEGER) AS n_apertures_agree,
  array_to_string(list_sort(list_distinct(list_transform(m, lambda x: x.aperture))), ',') AS apertures_agree,
  round(list_filter(m, lambda x: x.aperture = 'SML')[1].sde, 6) AS "sde_SML", coalesce(list_filter(m, lambda x: x.aperture = 'PRI')[1].peak_rank, 0) AS "rank_PRI" FROM cl""")
def consolidated_clusters(spark, d):
    c = S.consolidate(B.peaks(spark, d), B.APERTURES)
    return c.select("tic", r("period_d", 8).alias("period_d"), r("sde_max").alias("sde_max"), "rep_aperture", "rep_peak_rank", "n_members", "n_apertures_agree",
                    "apertures_agree", r("sde_SML").alias("sde_SML"), "rank_PRI")


ENVELOPE = ("2.0::DOUBLE * (0.018::DOUBLE * 6.957e8 + 2.0::DOUBLE * 6.9911e7) / pow(2 * pi() * 0.4::DOUBLE * 1.32712440e20 / (period_d * 86400.0::DOUBLE), 1.0::DOUBLE / 3.0::DOUBLE) / 60.0::DOUBLE + 3.34::DOUBLE")
VET = f""",
vb AS (SELECT *, count(*) OVER (PARTITION BY floor(log10(period_d) / log10(1.001::DOUBLE))) AS crowd, {ENVELOPE} AS env FROM src),
vc AS (SELECT *, env >= 30 OR duration_min <= env AS dp, duration_min >= 30 AS ceil_hit, period_d >= 0.10 AS ap, period_d >= 12.6::DOUBLE / 24 * sqrt(1.33::DOUBLE / 7.87::DOUBLE) AS rp FROM vb),
vet AS (SELECT *, CASE WHEN NOT dp THEN 'duration_violator' WHEN NOT ap OR crowd > 50 THEN 'alias_artifact' WHEN ceil_hit THEN 'pceb_grid_ceiling' WHEN NOT rp THEN 'sub_roche_pceb_suspect' ELSE 'planet_candidate' END AS vet_class FROM vc)"""


@query("vet_features", PEAKS, "src AS (SELECT * FROM peaks WHERE sde > 7)" + VET, sql="""
SELECT tic, aperture, peak_rank, uid_a, uid_b, round(period_d, 8) AS period_d, round(env, 6) AS env, crowd, dp, ceil_hit, ap, rp, vet_class FROM vet""")
def vet_features(spark, d):
    f = V.vet_features(B.peaks(spark, d).where("sde > 7"), 30.0)
    return f.select("tic", "aperture", "peak_rank", "uid_a", "uid_b", r("period_d", 8).alias("period_d"), r("dur_envelope_min").alias("env"), F.col("period_cluster_count").alias("crowd"),
                    F.col("dur_envelope_pass").alias("dp"), F.col("dur_grid_ceiling_hit").alias("ceil_hit"), F.col("p_alias_pass").alias("ap"), F.col("roche_pass").alias("rp"), "vet_class")


@query("vetted_targets", PEAKS, "src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY sde DESC, period_d, t0_bjd) AS rn FROM peaks) WHERE rn = 1)" + VET, sql="""
SELECT tic, round(sde, 6) AS sde_max, vet_class, vet_class = 'planet_candidate' AND sde >= 7 AS vet_pass FROM vet""")
def vetted_targets(spark, d):
    p = B.peaks(spark, d).withColumnRenamed("sde", "sde_max")
    return V.vetted_targets(p, 30.0).select("tic", r("sde_max").alias("sde_max"), "vet_class", "vet_pass")


@query("regime_top_targets", PEAKS, sql="""
, f AS (SELECT * FROM peaks WHERE period_d > 0.04 AND period_d < 13 AND sde > 7),
b AS (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY sde DESC, period_d, t0_bjd) AS rn FROM f)
SELECT tic, round(sde, 6) AS sde_max, round(period_d, 8) AS period_d FROM b WHERE rn = 1 ORDER BY sde DESC, tic LIMIT 200""")
def regime_top_targets(spark, d):
    p = B.peaks(spark, d).withColumnRenamed("sde", "sde_max")
    return V.top_targets(V.regime_filter(p), 200).select("tic", r("sde_max").alias("sde_max"), r("period_d", 8).alias("period_d"))


@query("class_ranked_candidates", PEAKS, "src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY sde DESC, period_d, t0_bjd) AS rn FROM peaks) WHERE rn = 1)" + VET, sql="""
SELECT vet_class, class_rank, tic, round(sde, 6) AS sde_max FROM (SELECT *, row_number() OVER (PARTITION BY vet_class ORDER BY sde DESC, tic) AS class_rank FROM vet) WHERE class_rank <= 25""")
def class_ranked_candidates(spark, d):
    p = B.peaks(spark, d).withColumnRenamed("sde", "sde_max")
    return V.class_top(V.vetted_targets(p, 30.0), 25).select("vet_class", F.col("class_rank").cast("bigint").alias("class_rank"), "tic", r("sde_max").alias("sde_max"))


OVER = lambda p, t, d, tp, tt, td: f"greatest(0, ({d} + {td}) / 2 - abs({PH(t, f'least({p}, {tp})', tt)} * 1440)) / least({d}, {td})"
PH = lambda t, p, t0: f"(({t} - {t0} + {p} / 2) - {p} * floor(({t} - {t0} + {p} / 2) / {p}) - {p} / 2)"
FACTORS = "(VALUES (0.25::DOUBLE, 0), (1.0::DOUBLE / 3.0::DOUBLE, 1), (0.5::DOUBLE, 2), (1.0::DOUBLE, 3), (2.0::DOUBLE, 4), (3.0::DOUBLE, 5), (4.0::DOUBLE, 6)) fx(factor, pos)"
TRUTH = f"""
tj AS (SELECT p.*, i.truth_period_d, i.truth_t0_bjd, i.truth_duration_min, i.grid_period_bin, i.grid_radius_bin, i.tmag AS truth_tmag, i.n_good_in_transit, i.model_depth FROM peaks p JOIN injections i ON p.injection_id = i.injection_id),
tk AS (SELECT *, abs(period_d - truth_period_d) / truth_period_d AS rel, {PH('t0_bjd', 'truth_period_d', 'truth_t0_bjd')} * 1440 AS perr, {PH('t0_bjd', 'least(period_d, truth_period_d)', 'truth_t0_bjd')} * 1440 AS delta,
   least(1, {OVER('period_d', 't0_bjd', 'duration_min', 'truth_period_d', 'truth_t0_bjd', 'truth_duration_min')}) AS frac, greatest(truth_duration_min, 20) AS lim,
   (SELECT min({{'e': abs(period_d / truth_period_d - factor) / factor, 'pos': pos, 'f': factor}}) FROM {FACTORS}) AS h FROM tj),
truth AS (SELECT *, CASE WHEN frac >= 0.5 AND rel <= 0.02 AND abs(perr) <= lim THEN 'exact'
   WHEN frac >= 0.5 AND abs(h.f - 1) >= 1e-8 AND h.e <= 0.02 AND abs(delta) <= lim THEN 'harmonic' ELSE 'mismatch' END AS match_kind FROM tk)"""


@query("truth_labelled_peaks", PEAKS, INJECTIONS, TRUTH, sql="""
SELECT injection_id, aperture, peak_rank, uid_a, uid_b, match_kind, round(rel, 8) AS rel, round(frac, 4) AS overlap, h.f AS factor FROM truth""")
def truth_labelled_peaks(spark, d):
    t = V.truth_labelled(B.peaks(spark, d), B.injections(spark, d))
    return t.select("injection_id", "aperture", "peak_rank", "uid_a", "uid_b", "match_kind", r("period_rel_err", 8).alias("rel"), r("window_overlap_fraction", 4).alias("overlap"),
                    F.col("nearest_harmonic_factor").alias("factor"))


@query("harmonic_queue_match", PEAKS, QUEUE, f"""
hp AS (SELECT tic, period_d, min(peak_rank) AS rk FROM peaks WHERE peak_rank <= 10 GROUP BY ALL),
hm AS (SELECT q.review_id, abs(p.period_d / q.period_d - factor) / factor AS e, p.rk, factor, p.period_d AS pp FROM queue q JOIN hp p ON p.tic = q.tic, {FACTORS}
   WHERE abs(p.period_d / q.period_d - factor) / factor <= 0.02),
hb AS (SELECT * FROM hm QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY e, rk, factor, pp) = 1),
h1 AS (SELECT DISTINCT review_id FROM hm WHERE rk = 1)""", sql="""
SELECT q.review_id, round(e, 8) AS match_rel_err, rk AS match_rank, factor AS match_factor, CASE WHEN rk IS NULL THEN 'unmatched' WHEN h1.review_id IS NOT NULL THEN 'rank1' ELSE 'topn' END AS match_status
FROM queue q LEFT JOIN hb ON hb.review_id = q.review_id LEFT JOIN h1 ON h1.review_id = q.review_id""")
def harmonic_queue_match(spark, d):
    m = V.harmonic_match(B.queue(spark, d), B.peaks(spark, d))
    return m.select("review_id", r("match_rel_err", 8).alias("match_rel_err"), "match_rank", "match_factor", "match_status")


@query("label_transfer_by_period", PEAKS, QUEUE, HUMAN_LABELS, """
lb AS (SELECT q.*, l.label FROM queue q JOIN human_labels l USING (review_id)),
ll AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY tic ORDER BY review_id DESC) = 1),
hp AS (SELECT tic, period_d, min(peak_rank) AS rk FROM peaks WHERE peak_rank <= 10 GROUP BY ALL),
hm AS (SELECT q.review_id, abs(p.period_d / q.period_d - 1) AS e, p.rk, p.period_d AS pp FROM ll q JOIN hp p ON p.tic = q.tic WHERE abs(p.period_d / q.period_d - 1) <= 0.05),
hb AS (SELECT * FROM hm QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY e, rk, pp) = 1)""", sql="""
SELECT ll.tic, ll.review_id, label, rk AS match_rank, CASE WHEN rk IS NULL THEN 'no_period_match' WHEN rk <= 5 THEN 'transferred' ELSE 'rank_too_deep' END AS transfer_status FROM ll LEFT JOIN hb ON hb.review_id = ll.review_id""")
def label_transfer_by_period(spark, d):
    lab = B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", "label"), "review_id")
    return V.label_transfer(lab, B.peaks(spark, d), 0.05).select("tic", "review_id", "label", "match_rank", "transfer_status")


@query("label_transfer_by_window", PEAKS, QUEUE, HUMAN_LABELS, f"""
lb AS (SELECT q.*, l.label FROM queue q JOIN human_labels l USING (review_id)),
hm AS (SELECT q.review_id, q.label, abs(p.period_d / q.period_d - factor) / factor AS e, least(1, {OVER('p.period_d', 'p.t0_bjd', 'p.duration_min', 'q.period_d', 'q.t0_bjd', 'q.duration_min')}) AS o,
   p.peak_rank AS rk, factor, p.aperture, p.period_d AS pp, p.t0_bjd AS pt, p.duration_min AS pd FROM lb q JOIN peaks p ON p.tic = q.tic, {FACTORS} WHERE abs(p.period_d / q.period_d - factor) / factor <= 0.1),
hb AS (SELECT * FROM hm WHERE o >= 0.5 OR label = 'stellar_variability' QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY e, o DESC, rk, aperture, pp, pt, pd) = 1)""", sql="""
SELECT lb.review_id, lb.label, round(e, 8) AS rel_err, round(o, 4) AS overlap, rk AS peak_rank, factor, hb.review_id IS NOT NULL AS transferred FROM lb LEFT JOIN hb ON hb.review_id = lb.review_id""")
def label_transfer_by_window(spark, d):
    lab = B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", "label"), "review_id")
    t = V.label_transfer_windowed(lab, B.peaks(spark, d), 0.1)
    return t.select("review_id", "label", r("rel_err", 8).alias("rel_err"), r("overlap", 4).alias("overlap"), "peak_rank", "factor", "transferred")


REL = ("CASE WHEN NOT coalesce(cp > 0, false) THEN 'missing' WHEN abs(cp / period_d - 1) <= 0.01 THEN 'exact' WHEN least("
       + ", ".join(f"abs(cp / period_d - {f}) / {f}" for f in ("0.25::DOUBLE", "(1.0::DOUBLE / 3.0::DOUBLE)", "0.5::DOUBLE", "2.0::DOUBLE", "3.0::DOUBLE", "4.0::DOUBLE")) + ") <= 0.01 THEN 'harmonic' ELSE 'unrelated' END")


@query("anchor_with_context", PEAKS, f"""
cx AS (SELECT tic, period_d AS cp, sde AS cs FROM peaks WHERE aperture = 'PRI' AND peak_rank = 1 QUALIFY row_number() OVER (PARTITION BY tic ORDER BY sde DESC, period_d, t0_bjd) = 1),
an AS (SELECT a.*, cp, cs, {REL} AS rel FROM peaks a LEFT JOIN cx ON cx.tic = a.tic WHERE aperture = 'SML' AND peak_rank <= 3)""", sql="""
SELECT tic, peak_rank, uid_a, uid_b, round(cp, 8) AS ctx_period_d, rel AS period_relation, CASE WHEN rel IN ('exact', 'harmonic') THEN 2 ELSE 1 END AS n_apertures_agree FROM an""")
def anchor_with_context(spark, d):
    a = V.anchor_context(B.peaks(spark, d), "SML", "PRI")
    return a.select("tic", "peak_rank", "uid_a", "uid_b", r("ctx_period_d", 8).alias("ctx_period_d"), "period_relation", "n_apertures_agree")


@query("two_aperture_pool", PEAKS, """
ts AS (SELECT tic, period_d AS sp, sde AS ss FROM peaks WHERE aperture = 'SML' AND peak_rank = 1 QUALIFY row_number() OVER (PARTITION BY tic ORDER BY sde DESC, period_d, t0_bjd) = 1),
tp AS (SELECT tic, period_d AS pp, sde AS ps FROM peaks WHERE aperture = 'PRI' AND peak_rank = 1 QUALIFY row_number() OVER (PARTITION BY tic ORDER BY sde DESC, period_d, t0_bjd) = 1)""", sql="""
SELECT p.tic, aperture, peak_rank, uid_a, uid_b, round(CASE WHEN aperture = 'SML' THEN period_d ELSE sp END, 8) AS small_period_d, round(CASE WHEN aperture = 'PRI' THEN sde ELSE ps END, 6) AS primary_sde
FROM peaks p LEFT JOIN ts ON ts.tic = p.tic LEFT JOIN tp ON tp.tic = p.tic WHERE (aperture = 'SML' AND peak_rank <= 3) OR (aperture = 'PRI' AND peak_rank <= 1)""")
def two_aperture_pool(spark, d):
    t = V.two_aperture_pool(B.peaks(spark, d), "SML", "PRI")
    return t.select("tic", "aperture", "peak_rank", "uid_a", "uid_b", r("small_period_d", 8).alias("small_period_d"), r("primary_sde").alias("primary_sde"))


@query("benchmark_recovery_audit", PEAKS, f"""
t1 AS (SELECT * FROM peaks WHERE peak_rank = 1 QUALIFY row_number() OVER (PARTITION BY tic, aperture ORDER BY sde DESC, period_d, t0_bjd) = 1),
rv AS (SELECT tic, aperture, max(sde) AS rs FROM peaks WHERE peak_rank > 1 AND period_d < 0.2 GROUP BY ALL),
fl AS (SELECT t1.tic, t1.aperture, abs(period_d / 5 - 0.5) / 0.5 <= 0.05 OR abs(period_d / 5 - 1) <= 0.05 OR abs(period_d / 5 - 2) / 2 <= 0.05 AS period_pass,
  abs({PH('t0_bjd', '5.0::DOUBLE', '2457001.0::DOUBLE')} * 1440) <= 1000 AS phase_pass, depth >= 0.05::DOUBLE AS depth_pass, sde >= 10 AS sde_pass, coalesce(sde - rs > 2, true) AS rival_pass FROM t1 LEFT JOIN rv ON rv.tic = t1.tic AND rv.aperture = t1.aperture)""", sql="""
SELECT *, period_pass AND phase_pass AND depth_pass AND sde_pass AND rival_pass AS recovered FROM fl""")
def benchmark_recovery_audit(spark, d):
    return V.benchmark_recovery(B.peaks(spark, d), 5.0, 2457001.0, 0.05, 1000.0, 0.05, 10.0)


@query("flagship_search")
def flagship_search(spark, d):
    """Clean, 200-period search over two apertures, consolidation, vetting."""
    c, hot = curves(spark, d)
    rows = S.search(c, CFG, hot).where("status = 'ok'")
    peaks = rows.select("tic", F.lit(1).alias("sector"), F.lit(1).alias("cam"), F.lit(1).alias("ccd"), F.lit(16.0).alias("tmag"), "aperture", "peak_rank", "period_d",
                        (F.col("t0") + K.TIME_ZERO).alias("t0_bjd"), "duration_min", "depth", "depth_snr", "sde", F.col("n_all").alias("n_cad_kept"), "baseline_d",
                        "status", F.lit("run1").alias("bls_run_id"))
    clusters = S.consolidate(peaks, B.APERTURES, sde_min=2.0)
    v = V.vet_features(clusters, 600.0)
    return v.select("tic", "period_d", "t0_bjd", "duration_min", "depth", "sde_max", "rep_aperture", "n_apertures_agree", "apertures_agree", "vet_class") \
        .orderBy(F.desc("n_apertures_agree"), F.desc("sde_max"), "tic", "period_d")
