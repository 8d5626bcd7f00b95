"""Queries of recovery accounting over labelled peaks and injections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import exprs as E
from lumensift.operators import recovery as R, vet as V
from lumensift.plans.registry import query, r
from lumensift.plans.search_queries import TRUTH
from lumensift.plans.views import INJECTIONS, PEAKS
from lumensift.sources import binding as B

OUT = """
oc AS (SELECT injection_id, bool_or(match_kind <> 'mismatch' AND peak_rank = 1) AS top1, bool_or(match_kind <> 'mismatch' AND peak_rank <= 5) AS topk,
  bool_or(match_kind = 'exact' AND peak_rank <= 5) AS exact_topk, bool_or(match_kind = 'harmonic' AND peak_rank <= 5) AS harmonic_topk,
  min(peak_rank) FILTER (WHERE match_kind <> 'mismatch') AS best_signal_rank, count(*) AS n_peaks, any_value(truth_tmag) AS truth_tmag, any_value(truth_period_d) AS truth_period_d,
  any_value(grid_period_bin) AS grid_period_bin, any_value(grid_radius_bin) AS grid_radius_bin, any_value(n_good_in_transit) AS n_good_in_transit, any_value(model_depth) AS model_depth FROM truth GROUP BY injection_id)"""
BASE = (PEAKS, INJECTIONS, TRUTH, OUT)
TBIN = "CASE WHEN {} < 17 THEN 'Tmag < 17' WHEN {} < 18 THEN '17 <= Tmag < 18' WHEN {} < 19 THEN '18 <= Tmag < 19' ELSE 'Tmag >= 19' END"
tb = lambda c: TBIN.format(c, c, c)


def labelled(spark, d):
    return V.truth_labelled(B.peaks(spark, d), B.injections(spark, d))


def outcomes(spark, d):
    return R.injection_outcomes(labelled(spark, d))


@query("injection_outcomes", *BASE, sql="SELECT injection_id, top1, topk, exact_topk, harmonic_topk, best_signal_rank, n_peaks, topk AND NOT top1 AS ranking_loss FROM oc")
def injection_outcomes(spark, d):
    return outcomes(spark, d).select("injection_id", "top1", "topk", "exact_topk", "harmonic_topk", "best_signal_rank", "n_peaks", "ranking_loss")


CELL = """
gr AS (SELECT tmag_bin, grid_period_bin, grid_radius_bin, count(*) AS n, count(*) FILTER (WHERE top1) AS n_top1, count(*) FILTER (WHERE topk) AS n_topk FROM (SELECT *, """ + tb("truth_tmag") + """ AS tmag_bin FROM oc) GROUP BY ALL)"""
CELLS = ("tmag_bin", "grid_period_bin", "grid_radius_bin")


def cell_table(spark, d):
    return R.cell_grid(outcomes(spark, d).withColumn("tmag_bin", E.tmag_bin("truth_tmag")), CELLS, 20, 0.2)


@query("recovery_cell_grid", *BASE, CELL, sql="""
SELECT *, round(n_top1 / n, 8) AS top1_fraction, round(n_topk / n, 8) AS topk_fraction, CASE WHEN n < 20 THEN 'low_support' WHEN n_topk / n >= 0.2 THEN 'recoverable' ELSE 'limited' END AS gate FROM gr""")
def recovery_cell_grid(spark, d):
    return cell_table(spark, d).withColumns({"top1_fraction": r("top1_fraction", 8), "topk_fraction": r("topk_fraction", 8)})


@query("cell_annotated_injections", *BASE, CELL, sql="""
SELECT injection_id, round(n_topk / n, 8) AS cell_fraction, CASE WHEN n < 20 THEN 'low_support' WHEN n_topk / n >= 0.2 THEN 'recoverable' ELSE 'limited' END AS gate
FROM oc JOIN gr ON gr.tmag_bin = """ + tb("truth_tmag") + " AND gr.grid_period_bin = oc.grid_period_bin AND gr.grid_radius_bin = oc.grid_radius_bin")
def cell_annotated_injections(spark, d):
    o = outcomes(spark, d).withColumn("tmag_bin", E.tmag_bin("truth_tmag"))
    return R.annotate_with_cells(o, cell_table(spark, d), CELLS).select("injection_id", r("cell_fraction", 8).alias("cell_fraction"), "gate")


@query("recovery_global_summary", *BASE, sql="""
SELECT count(*) AS n, count(*) FILTER (WHERE top1) AS n_top1, count(*) FILTER (WHERE topk) AS n_topk, count(*) FILTER (WHERE topk AND NOT top1) AS n_loss,
 round(count(*) FILTER (WHERE topk) / count(*), 8) AS topk_fraction, round(count(*) FILTER (WHERE topk AND NOT top1) / count(*), 8) AS loss_fraction,
 CASE WHEN count(*) FILTER (WHERE topk) / count(*) < 0.2 THEN 'improve_search' WHEN count(*) FILTER (WHERE topk AND NOT top1) / count(*) >= 0.05 THEN 'train_ranker' ELSE 'keep_rank' END AS recommendation FROM oc""")
def recovery_global_summary(spark, d):
    return R.global_summary(outcomes(spark, d)).withColumns({k: r(k, 8) for k in ("topk_fraction", "loss_fraction")})


MODES = """
pr AS (SELECT *, """ + tb("truth_tmag") + """ AS tmag_bin, abs(model_depth) * sqrt(n_good_in_transit) AS proxy FROM oc),
rf AS (SELECT tmag_bin, median(proxy) AS bin_ref, count(*) AS n_ref FROM pr WHERE topk GROUP BY ALL), ra AS (SELECT median(proxy) AS all_ref FROM pr WHERE topk),
fm AS (SELECT pr.*, CASE WHEN n_ref >= 5 THEN bin_ref ELSE all_ref END AS reference, CASE WHEN top1 THEN 'recovered_top1' WHEN topk THEN 'recovered_topk' WHEN best_signal_rank IS NOT NULL THEN 'ranked_too_deep'
  WHEN proxy >= CASE WHEN n_ref >= 5 THEN bin_ref ELSE all_ref END THEN 'observable_missed' ELSE 'weak_signal' END AS failure_mode FROM pr LEFT JOIN rf USING (tmag_bin), ra)"""


@query("failure_modes", *BASE, MODES, sql="SELECT injection_id, tmag_bin, round(proxy, 6) AS proxy, round(reference, 6) AS reference, failure_mode FROM fm")
def failure_modes(spark, d):
    return R.failure_modes(outcomes(spark, d)).select("injection_id", "tmag_bin", r("proxy").alias("proxy"), r("reference").alias("reference"), "failure_mode")


@query("failure_grid", *BASE, MODES, sql="""
SELECT grid_period_bin, grid_radius_bin, count(*) AS n, count(*) FILTER (WHERE failure_mode = 'observable_missed') AS n_observable_missed, count(*) FILTER (WHERE failure_mode = 'ranked_too_deep') AS n_deep,
 round(median(proxy), 6) AS median_proxy FROM fm GROUP BY ALL""")
def failure_grid(spark, d):
    return R.failure_grid(R.failure_modes(outcomes(spark, d)), ["grid_period_bin", "grid_radius_bin"]).withColumn("median_proxy", r("median_proxy"))


@query("failure_modes_by_bin", *BASE, MODES, sql="""
SELECT tmag_bin, count(*) AS n, count(*) FILTER (WHERE failure_mode = 'recovered_top1') AS recovered_top1, count(*) FILTER (WHERE failure_mode = 'recovered_topk') AS recovered_topk,
 count(*) FILTER (WHERE failure_mode = 'observable_missed') AS observable_missed, count(*) FILTER (WHERE failure_mode = 'weak_signal') AS weak_signal FROM fm GROUP BY ALL""")
def failure_modes_by_bin(spark, d):
    return R.mode_by_bin(R.failure_modes(outcomes(spark, d)), "tmag_bin", "failure_mode", ["recovered_top1", "recovered_topk", "observable_missed", "weak_signal"])


@query("recovery_marginals", *BASE, sql="""
, ax AS (SELECT """ + tb("truth_tmag") + """ AS tmag_bin, CAST(grid_period_bin AS VARCHAR) AS pb, CAST(grid_radius_bin AS VARCHAR) AS rb, topk FROM oc)
SELECT 'tmag_bin' AS axis, tmag_bin AS level, count(*) AS n, count(*) FILTER (WHERE topk) AS n_recovered, round(count(*) FILTER (WHERE topk) / count(*), 8) AS fraction FROM ax GROUP BY tmag_bin
UNION ALL SELECT 'grid_period_bin', pb, count(*), count(*) FILTER (WHERE topk), round(count(*) FILTER (WHERE topk) / count(*), 8) FROM ax GROUP BY pb
UNION ALL SELECT 'grid_radius_bin', rb, count(*), count(*) FILTER (WHERE topk), round(count(*) FILTER (WHERE topk) / count(*), 8) FROM ax GROUP BY rb""")
def recovery_marginals(spark, d):
    o = outcomes(spark, d).withColumn("tmag_bin", E.tmag_bin("truth_tmag"))
    return R.marginals(o, ["tmag_bin", "grid_period_bin", "grid_radius_bin"], "topk").withColumn("fraction", r("fraction", 8))


PE, DE = [0.0, 3.0, 6.0, 9.0, 12.0, 16.0], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
XB = "CASE " + " ".join(f"WHEN truth_period_d >= {a} AND truth_period_d < {b} THEN {i}" for i, (a, b) in enumerate(zip(PE, PE[1:]))) + " END"
YB = "CASE " + " ".join(f"WHEN model_depth >= {a}::DOUBLE AND model_depth < {b}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(DE, DE[1:]))) + " END"
GRID2 = f"""
g2 AS (SELECT CAST({XB} AS BIGINT) AS xi, CAST({YB} AS BIGINT) AS yi, count(*) AS n, count(*) FILTER (WHERE topk) AS n_recovered FROM oc GROUP BY 1, 2),
gf AS (SELECT *, CASE WHEN n >= 5 THEN n_recovered / n END AS fraction FROM g2 WHERE xi IS NOT NULL AND yi IS NOT NULL)"""


def grid2(spark, d):
    return R.grid_fraction(outcomes(spark, d), F.col("truth_period_d"), F.col("model_depth"), PE, DE, "topk", 5)


@query("period_depth_grid", *BASE, GRID2, sql="SELECT xi, yi, n, n_recovered, round(fraction, 8) AS fraction FROM gf")
def period_depth_grid(spark, d):
    return grid2(spark, d).withColumn("fraction", r("fraction", 8))


@query("depth_boundary", *BASE, GRID2, sql="SELECT xi, min(yi) FILTER (WHERE fraction >= 0.15) AS boundary_yi, round(max(fraction), 8) AS max_fraction FROM gf GROUP BY xi")
def depth_boundary(spark, d):
    return R.depth_boundary(grid2(spark, d), 0.15).withColumn("max_fraction", r("max_fraction", 8))


@query("monotone_boundary", *BASE, GRID2, sql="""
, mo AS (SELECT *, max(fraction) OVER (PARTITION BY xi ORDER BY yi) AS mono FROM gf WHERE fraction IS NOT NULL),
lg AS (SELECT *, lag(mono) OVER w AS pm, lag(yi) OVER w AS py FROM mo WINDOW w AS (PARTITION BY xi ORDER BY yi)),
cr AS (SELECT xi, yi, CASE WHEN pm IS NULL OR pm >= 0.15::DOUBLE THEN yi ELSE py + (0.15::DOUBLE - pm) / nullif(mono - pm, 0) * (yi - py) END AS y_cross FROM lg WHERE mono >= 0.15::DOUBLE)
SELECT xi, round(arg_min(y_cross, yi), 6) AS y_cross FROM cr GROUP BY xi""")
def monotone_boundary(spark, d):
    return R.monotone_boundary(grid2(spark, d), 0.15).withColumn("y_cross", r("y_cross"))


@query("smoothed_recovery_grid", *BASE, GRID2, sql="""
, k AS (SELECT i, j, exp(-(i * i + j * j) / 2.0::DOUBLE) AS w FROM range(-2, 3) a(i), range(-2, 3) b(j)), kt AS (SELECT sum(w) AS t FROM k),
sp AS (SELECT xi + i AS xi, yi + j AS yi, sum(n * w / t) AS count_s, sum(n_recovered * w / t) AS hit_s, any_value(t) AS t FROM g2, k, kt WHERE xi IS NOT NULL AND yi IS NOT NULL GROUP BY 1, 2)
SELECT xi, yi, round(count_s, 6) AS count_s, round(CASE WHEN count_s * t >= 2 THEN hit_s / count_s END, 6) AS fraction FROM sp WHERE xi BETWEEN 0 AND 4 AND yi BETWEEN 0 AND 4""")
def smoothed_recovery_grid(spark, d):
    return R.smoothed_grid(grid2(spark, d), 5, 5).withColumns({k: r(k) for k in ("count_s", "fraction")})


@query("kernel_recovery_surface", *BASE, sql="""
, gr AS (SELECT CAST(gx AS DOUBLE) AS gx, gy FROM (VALUES (2), (6), (10)) a(gx), (VALUES (0.1::DOUBLE), (0.4::DOUBLE), (0.7::DOUBLE)) b(gy)),
wt AS (SELECT gx, gy, topk, exp(-0.5::DOUBLE * (pow((truth_period_d - gx) / 2.0::DOUBLE, 2) + pow((model_depth - gy) / 0.2::DOUBLE, 2))) AS w FROM oc, gr)
SELECT gx, gy, round(sum(w * CAST(topk AS INTEGER)) / sum(w), 6) AS fraction, round(pow(sum(w), 2) / sum(w * w), 4) AS effective_n FROM wt GROUP BY ALL""")
def kernel_recovery_surface(spark, d):
    k = R.kernel_surface(outcomes(spark, d), F.col("truth_period_d"), F.col("model_depth"), "topk", [2, 6, 10], [0.1, 0.4, 0.7], 2.0, 0.2)
    return k.select("gx", "gy", r("fraction").alias("fraction"), r("effective_n", 4).alias("effective_n"))


@query("recall_at_k", *BASE, sql="""
, rk AS (SELECT injection_id, match_kind <> 'mismatch' AS sig, row_number() OVER (PARTITION BY injection_id ORDER BY peak_rank, aperture, uid_a, uid_b, period_d, sde) AS pos FROM truth),
bs AS (SELECT injection_id, min(pos) FILTER (WHERE sig) AS best FROM rk GROUP BY ALL)
SELECT k, (SELECT count(*) FROM bs WHERE best <= k) AS n, (SELECT count(*) FROM bs) AS denom, (SELECT count(best) FROM bs) AS rankable,
  round((SELECT count(*) FROM bs WHERE best <= k) / (SELECT count(*) FROM bs), 8) AS fraction, round((SELECT count(*) FROM bs WHERE best <= k) / (SELECT count(best) FROM bs), 8) AS rankable_fraction
FROM (VALUES (1), (2), (3), (5), (10), (20)) v(k)""")
def recall_at_k(spark, d):
    order = [F.col(c) for c in ("peak_rank", "aperture", "uid_a", "uid_b", "period_d", "sde")]
    return R.recall_at_k(labelled(spark, d), (1, 2, 3, 5, 10, 20), order).withColumns({k: r(k, 8) for k in ("fraction", "rankable_fraction")})


@query("peak_table_summary", *BASE, sql="""
SELECT count(*) AS n_rows, count(DISTINCT injection_id) AS n_injections, count(*) FILTER (WHERE match_kind <> 'mismatch') AS n_positive,
 count(DISTINCT CASE WHEN match_kind <> 'mismatch' THEN injection_id END) AS n_with_signal, count(*) FILTER (WHERE match_kind = 'harmonic') AS n_harmonic FROM truth""")
def peak_table_summary(spark, d):
    return R.peak_table_summary(labelled(spark, d))


@query("grid_support_audit", INJECTIONS, "ib AS (SELECT *, " + tb("tmag") + " AS tmag_bin FROM injections)", sql="""
, ce AS (SELECT tmag_bin, c AS cell FROM (SELECT DISTINCT tmag_bin FROM ib), range(25) x(c)), ct AS (SELECT tmag_bin, grid_period_bin * 5 + grid_radius_bin AS cell, count(*) AS n FROM ib GROUP BY ALL),
pe AS (SELECT ce.tmag_bin, coalesce(n, 0) AS n FROM ce LEFT JOIN ct ON ct.tmag_bin = ce.tmag_bin AND ct.cell = ce.cell),
s AS (SELECT tmag_bin, count(*) FILTER (WHERE n > 0) AS cells_represented, min(n) AS min_support, round(quantile_cont(CAST(n AS DOUBLE), 0.1), 6) AS p10_support, median(n) AS median_support, max(n) AS max_support FROM pe GROUP BY ALL),
h AS (SELECT tmag_bin, count(*) AS n_injections, count(DISTINCT tic) AS n_hosts FROM ib GROUP BY ALL)
SELECT h.*, cells_represented, min_support, p10_support, median_support, max_support, round(n_injections / n_hosts, 6) AS reuse FROM h JOIN s USING (tmag_bin)""")
def grid_support_audit(spark, d):
    return R.grid_support(B.injections(spark, d), 5, 5).withColumns({"p10_support": r("p10_support"), "reuse": r("reuse")})


@query("host_coverage_audit", INJECTIONS, sql="""
, m AS (SELECT tic, count(*) AS n FROM injections GROUP BY ALL), e AS (SELECT DISTINCT c_custkey AS tic FROM customer), j AS (SELECT e.tic AS et, n FROM e FULL JOIN m ON e.tic = m.tic)
SELECT count(*) FILTER (WHERE n IS NULL) AS targets_without, count(*) FILTER (WHERE et IS NULL) AS unknown_hosts, min(n) AS min_per_host, median(n) AS median_per_host, max(n) AS max_per_host FROM j""")
def host_coverage_audit(spark, d):
    return R.host_coverage(B.table(spark, d, "customer").select(F.col("c_custkey").alias("tic")), B.injections(spark, d))


SCORED = """
sc AS (SELECT *, match_kind <> 'mismatch' AS sig, sde / (sde + 10.0::DOUBLE) AS score_a, depth_snr / (depth_snr + 8.0::DOUBLE) AS score_b FROM truth WHERE peak_rank <= 5),
ga AS (SELECT injection_id, bool_or(sig) AS f, bool_or(sig AND score_a >= 0.5) AS ka, bool_or(sig AND score_b >= 0.5) AS kb, max(score_a) FILTER (WHERE sig) AS ms FROM sc GROUP BY ALL),
oa AS (SELECT i.injection_id, i.grid_period_bin, coalesce(f, false) AS found, coalesce(ka, false) AS kept_a, coalesce(kb, false) AS kept_b, ms FROM injections i LEFT JOIN ga USING (injection_id))"""


def scored(spark, d):
    return labelled(spark, d).withColumns({"score_a": F.col("sde") / (F.col("sde") + 10.0), "score_b": F.col("depth_snr") / (F.col("depth_snr") + 8.0)})


@query("scored_injection_outcomes", *BASE, SCORED, sql="SELECT injection_id, found, kept_a AS kept, round(ms, 8) AS max_signal_score FROM oa")
def scored_injection_outcomes(spark, d):
    o = R.scored_outcomes(B.injections(spark, d), scored(spark, d), "score_a", 0.5)
    return o.select("injection_id", "found", "kept", r("max_signal_score", 8).alias("max_signal_score"))


@query("outcome_fractions", *BASE, SCORED, sql="""
SELECT grid_period_bin, count(*) AS n, count(*) FILTER (WHERE found) AS n_found, count(*) FILTER (WHERE kept_a) AS n_kept, round(count(*) FILTER (WHERE found) / count(*), 8) AS found_fraction,
 round(count(*) FILTER (WHERE kept_a) / count(*), 8) AS kept_fraction, round(count(*) FILTER (WHERE kept_a) / nullif(count(*) FILTER (WHERE found), 0), 8) AS kept_given_found FROM oa GROUP BY ALL""")
def outcome_fractions(spark, d):
    o = R.scored_outcomes(B.injections(spark, d), scored(spark, d), "score_a", 0.5)
    return R.outcome_fractions(o, ["grid_period_bin"]).withColumns({k: r(k, 8) for k in ("found_fraction", "kept_fraction", "kept_given_found")})


@query("model_recovery_comparison", *BASE, SCORED, sql="""
SELECT 'a' AS model, count(*) AS n_common, count(*) FILTER (WHERE found) AS n_found, count(*) FILTER (WHERE kept_a) AS n_kept, round(count(*) FILTER (WHERE kept_a) / count(*), 8) AS end_to_end, round(count(*) FILTER (WHERE kept_a) / count(*) FILTER (WHERE found), 8) AS conditional FROM oa
UNION ALL SELECT 'b', count(*), count(*) FILTER (WHERE found), count(*) FILTER (WHERE kept_b), round(count(*) FILTER (WHERE kept_b) / count(*), 8), round(count(*) FILTER (WHERE kept_b) / count(*) FILTER (WHERE found), 8) FROM oa""")
def model_recovery_comparison(spark, d):
    s, i = scored(spark, d), B.injections(spark, d)
    c = R.compare_models({"a": R.scored_outcomes(i, s, "score_a", 0.5), "b": R.scored_outcomes(i, s, "score_b", 0.5)})
    return c.withColumns({k: r(k, 8) for k in ("end_to_end", "conditional")})


@query("branch_outcome_diff", PEAKS, INJECTIONS, TRUTH, sql="""
, a AS (SELECT injection_id, bool_or(match_kind <> 'mismatch' AND peak_rank <= 5) AS t, min(peak_rank) FILTER (WHERE match_kind <> 'mismatch') AS k FROM truth WHERE aperture = 'SML' GROUP BY ALL),
b AS (SELECT injection_id, bool_or(match_kind <> 'mismatch' AND peak_rank <= 5) AS t, min(peak_rank) FILTER (WHERE match_kind <> 'mismatch') AS k FROM truth WHERE aperture = 'PRI' GROUP BY ALL),
j AS (SELECT coalesce(a.injection_id, b.injection_id) AS injection_id, coalesce(a.t, false) AS bt, coalesce(b.t, false) AS nt, a.k AS bk, b.k AS nk FROM a FULL JOIN b ON a.injection_id = b.injection_id)
SELECT injection_id, CASE WHEN NOT bt AND nt THEN 'rescued' WHEN bt AND NOT nt THEN 'degraded' WHEN bt AND nt AND nk < bk THEN 'reranked_up' WHEN bt AND nt AND nk > bk THEN 'reranked_down' WHEN bt AND nt THEN 'same' ELSE 'missed_both' END AS change FROM j""")
def branch_outcome_diff(spark, d):
    l = labelled(spark, d)
    f = lambda a: R.injection_outcomes(l.where(F.col("aperture") == a))
    return R.branch_diff(f("SML"), f("PRI")).select("injection_id", "change")


@query("preset_confusion", *BASE, sql="""
, p AS (SELECT match_kind <> 'mismatch' AS t, sde >= 10 AND depth_snr >= 5 AS base, sde >= 10 AS loose, (sde >= 15 OR sde IS NULL) AND duration_min <= 20 AS strict FROM truth)
SELECT preset, tp, fp, fn, tn, added, round(tp / nullif(tp + fp, 0), 8) AS precision, round(tp / nullif(tp + fn, 0), 8) AS recall, round(tn / nullif(tn + fp, 0), 8) AS specificity FROM (
SELECT 'base' AS preset, count(*) FILTER (WHERE base AND t) AS tp, count(*) FILTER (WHERE base AND NOT t) AS fp, count(*) FILTER (WHERE NOT base AND t) AS fn, count(*) FILTER (WHERE NOT base AND NOT t) AS tn, CAST(0 AS BIGINT) AS added FROM p
UNION ALL SELECT 'loose', count(*) FILTER (WHERE loose AND t), count(*) FILTER (WHERE loose AND NOT t), count(*) FILTER (WHERE NOT loose AND t), count(*) FILTER (WHERE NOT loose AND NOT t), count(*) FILTER (WHERE loose AND NOT base) FROM p
UNION ALL SELECT 'strict', count(*) FILTER (WHERE strict AND t), count(*) FILTER (WHERE strict AND NOT t), count(*) FILTER (WHERE NOT strict AND t), count(*) FILTER (WHERE NOT strict AND NOT t), count(*) FILTER (WHERE strict AND NOT base) FROM p)""")
def preset_confusion(spark, d):
    sde = F.col("sde")
    ps = {"base": (sde >= 10) & (F.col("depth_snr") >= 5), "loose": sde >= 10, "strict": ((sde >= 15) | sde.isNull()) & (F.col("duration_min") <= 20)}
    return R.preset_confusion(labelled(spark, d), ps, "is_signal", "base").withColumns({k: r(k, 8) for k in ("precision", "recall", "specificity")})


@query("aperture_snr_summary", PEAKS, sql="""
, b AS (SELECT '*' AS aperture, max(depth_snr) AS depth_snr FROM peaks GROUP BY tic)
SELECT aperture, count(*) AS n, count(*) FILTER (WHERE depth_snr >= 7) AS n_recoverable, round(median(depth_snr), 6) AS median_snr, round(quantile_cont(depth_snr, 0.9), 6) AS p90_snr
FROM (SELECT aperture, depth_snr FROM peaks UNION ALL SELECT * FROM b) GROUP BY ALL""")
def aperture_snr_summary(spark, d):
    return R.best_of_group(B.peaks(spark, d), ["tic"], "aperture", "depth_snr", 7.0).withColumns({k: r(k) for k in ("median_snr", "p90_snr")})


@query("current_vs_best_aperture", PEAKS, sql="""
, g AS (SELECT injection_id, max(depth_snr) FILTER (WHERE aperture = 'SML') AS c, max(depth_snr) AS b, max({'s': depth_snr, 'a': aperture}).a AS best_aperture FROM peaks GROUP BY ALL)
SELECT injection_id, round(c, 6) AS current_snr, round(b, 6) AS best_snr, best_aperture, round(b - c, 6) AS gain, b >= 7 AND coalesce(c, 0) < 7 AS newly_recoverable FROM g""")
def current_vs_best_aperture(spark, d):
    c = R.current_vs_best(B.peaks(spark, d), ["injection_id"], "aperture", "SML", "depth_snr", 7.0)
    return c.withColumns({k: r(k) for k in ("current_snr", "best_snr", "gain")})


@query("sweep_deltas", *BASE, sql="""
, m AS (SELECT DISTINCT CASE uid_b % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'fine' ELSE 'wide' END AS sweep, injection_id FROM truth WHERE match_kind <> 'mismatch'),
b AS (SELECT injection_id FROM m WHERE sweep = 'base')
SELECT sweep, count(*) AS n_matched, count(*) FILTER (WHERE m.injection_id NOT IN (SELECT injection_id FROM b)) AS n_new, (SELECT count(*) FROM b) - count(*) FILTER (WHERE m.injection_id IN (SELECT injection_id FROM b)) AS n_lost,
 count(*) FILTER (WHERE m.injection_id NOT IN (SELECT injection_id FROM b)) - (SELECT count(*) FROM b) + count(*) FILTER (WHERE m.injection_id IN (SELECT injection_id FROM b)) AS net FROM m GROUP BY ALL""")
def sweep_deltas(spark, d):
    k = F.col("uid_b") % 3
    l = labelled(spark, d).select("injection_id", F.col("is_signal").alias("matched"), F.when(k == 0, "base").when(k == 1, "fine").otherwise("wide").alias("sweep"))
    return R.sweep_deltas(l, "base")


@query("recovery_classes", *BASE, sql="""
, c AS (SELECT injection_id, bool_or(match_kind = 'exact' AND peak_rank = 1) AS strict, bool_or(match_kind = 'exact' AND peak_rank <= 5) AS topn_exact, bool_or(match_kind = 'harmonic' AND peak_rank <= 5) AS topn_harmonic FROM truth GROUP BY ALL)
SELECT *, strict OR topn_exact OR topn_harmonic AS any_recovered, CASE WHEN strict THEN 'bls_top1_recovered' WHEN topn_exact THEN 'bls_topn_recovered' WHEN topn_harmonic THEN 'bls_topn_harmonic_match' ELSE 'bls_mismatch' END AS recovery_mode FROM c""")
def recovery_classes(spark, d):
    return R.recovery_classes(labelled(spark, d))


@query("debug_priority_reasons", *BASE, sql="""
, g AS (SELECT injection_id, max(depth_snr) FILTER (WHERE aperture = 'SML') AS c, max(depth_snr) AS b FROM peaks GROUP BY ALL)
SELECT oc.injection_id, CASE WHEN topk AND NOT top1 AND b >= 7 AND coalesce(c, 0) < 7 THEN 'ranking_loss+newly_recoverable' WHEN topk AND NOT top1 THEN 'ranking_loss' WHEN b >= 7 AND coalesce(c, 0) < 7 THEN 'newly_recoverable' ELSE 'context' END AS reason
FROM oc LEFT JOIN g USING (injection_id)""")
def debug_priority_reasons(spark, d):
    c = R.current_vs_best(B.peaks(spark, d), ["injection_id"], "aperture", "SML", "depth_snr", 7.0)
    return R.debug_reasons(outcomes(spark, d), c).select("injection_id", "reason")
