"""Queries of quality gates and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions.hashing import stable_fold
from lumensift.operators import gates as G, metrics as M
from lumensift.operators.ordering import cut_lineage
from lumensift.operators.skew import with_row
from lumensift.plans.cadence_queries import NORM, curves
from lumensift.plans.model_queries import levels
from lumensift.plans.registry import query, r
from lumensift.plans.recovery_queries import labelled
from lumensift.plans.search_queries import TRUTH
from lumensift.plans.views import CADENCES, HUMAN_LABELS, INJECTIONS, PEAKS
from lumensift.sources import binding as B

AM = NORM + """,
mm AS (SELECT *, median(y) OVER (PARTITION BY tic, aperture) AS ym FROM y), md AS (SELECT tic, aperture, 1.4826 * median(abs(y - ym)) * 1e6 AS mad_ppm FROM mm GROUP BY ALL),
a1 AS (SELECT *, median(abs(y - ym)) OVER (PARTITION BY tic, aperture) AS dv FROM mm), k1 AS (SELECT tic, aperture, y FROM a1 WHERE dv <= 0 OR abs(y - ym) <= 5.0::DOUBLE * 1.4826::DOUBLE * dv),
a2 AS (SELECT *, median(y) OVER (PARTITION BY tic, aperture) AS ym FROM k1), b2 AS (SELECT *, median(abs(y - ym)) OVER (PARTITION BY tic, aperture) AS dv FROM a2), k2 AS (SELECT tic, aperture, y FROM b2 WHERE dv <= 0 OR abs(y - ym) <= 5.0::DOUBLE * 1.4826::DOUBLE * dv),
a3 AS (SELECT *, median(y) OVER (PARTITION BY tic, aperture) AS ym FROM k2), rm AS (SELECT tic, aperture, sqrt(avg(pow(y - ym, 2))) * 1e6 AS rms5_ppm FROM a3 GROUP BY ALL),
ba AS (SELECT tic, aperture, count(*) AS n_cadences, avg(CASE WHEN quality = 0 THEN 1.0::DOUBLE ELSE 0 END) AS quality0_fraction, count(*) FILTER (WHERE quality = 0 AND isfinite(flux)) / nullif(count(*) FILTER (WHERE quality = 0), 0) AS finite_q0_fraction FROM cadences GROUP BY ALL),
am AS (SELECT ba.*, mad_ppm, rms5_ppm FROM ba LEFT JOIN md USING (tic, aperture) LEFT JOIN rm USING (tic, aperture))"""
PM = """
pp AS (SELECT tic, cadenceno, max(y) FILTER (WHERE aperture = 'SML') AS s, max(y) FILTER (WHERE aperture = 'PRI') AS p FROM y GROUP BY ALL), pq AS (SELECT *, p - s AS d FROM pp WHERE s IS NOT NULL AND p IS NOT NULL),
pr AS (SELECT *, median(d) OVER w AS dm, median(s) OVER w AS sm, median(p) OVER w AS pm FROM pq WINDOW w AS (PARTITION BY tic)),
pair AS (SELECT tic, count(*) AS n_common, corr(s, p) AS correlation, 1.4826 * median(abs(d - dm)) * 1e6 AS diff_mad_ppm, median(abs(p - pm)) / nullif(median(abs(s - sm)), 0) AS mad_ratio FROM pr GROUP BY ALL)"""
AN = """
rf AS (SELECT DISTINCT tic, aperture, cadenceno, CASE WHEN cadenceno % 400 = 3 THEN 1 - quality ELSE quality END AS q, CASE WHEN cadenceno % 500 = 9 THEN orbitid + 1 ELSE orbitid END AS o FROM cadences WHERE cadenceno % 250 <> 11),
ob AS (SELECT tic, aperture, cadenceno, count(*) AS k, max(quality) AS quality, max(orbitid) AS orbitid FROM cadences WHERE cadenceno % 300 <> 17 GROUP BY ALL),
aj AS (SELECT coalesce(ob.tic, rf.tic) AS tic, k, ob.quality, ob.orbitid, q, o, ob.tic IS NULL AS nl, rf.tic IS NULL AS nr FROM ob FULL JOIN rf ON ob.tic = rf.tic AND ob.aperture = rf.aperture AND ob.cadenceno = rf.cadenceno),
an AS (SELECT tic, count(*) FILTER (WHERE NOT nr) AS n_expected, count(*) FILTER (WHERE nl) AS n_missing, count(*) FILTER (WHERE nr) AS n_unexpected, count(*) FILTER (WHERE k > 1) AS n_duplicate, count(*) FILTER (WHERE NOT nl AND NOT nr AND quality <> q) AS n_quality_mismatch,
  count(*) FILTER (WHERE NOT nl AND NOT nr AND orbitid <> o) AS n_orbit_mismatch, count(*) FILTER (WHERE nl) / nullif(count(*) FILTER (WHERE NOT nr), 0) AS missing_fraction FROM aj GROUP BY tic)"""


def anomalies(spark, d):
    c = B.cadences(spark, d)
    k = F.col("cadenceno")
    ref = c.where(k % 250 != 11).select("tic", "aperture", k, F.when(k % 400 == 3, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(k % 500 == 9, F.col("orbitid") + 1).otherwise(F.col("orbitid")).alias("orbitid")).distinct()
    return G.cadence_anomalies(c.where(k % 300 != 17), ref)


@query("aperture_metrics", CADENCES, AM, sql="SELECT tic, aperture, n_cadences, round(quality0_fraction, 8) AS quality0_fraction, round(finite_q0_fraction, 8) AS finite_q0_fraction, round(mad_ppm, 3) AS mad_ppm, round(rms5_ppm, 3) AS rms5_ppm FROM am")
def aperture_metrics(spark, d):
    c, hot = curves(spark, d)
    return G.aperture_metrics(c, hot).select("tic", "aperture", "n_cadences", r("quality0_fraction", 8).alias("quality0_fraction"), r("finite_q0_fraction", 8).alias("finite_q0_fraction"), r("mad_ppm", 3).alias("mad_ppm"), r("rms5_ppm", 3).alias("rms5_ppm"))


@query("aperture_pair_metrics", CADENCES, NORM, PM, sql="SELECT tic, n_common, round(correlation, 7) AS correlation, round(diff_mad_ppm, 3) AS diff_mad_ppm, round(mad_ratio, 7) AS mad_ratio FROM pair")
def aperture_pair_metrics(spark, d):
    c, hot = curves(spark, d)
    return G.pair_metrics(c, "SML", "PRI", hot).select("tic", "n_common", r("correlation", 7).alias("correlation"), r("diff_mad_ppm", 3).alias("diff_mad_ppm"), r("mad_ratio", 7).alias("mad_ratio"))


@query("cadence_anomalies", CADENCES, AN, sql="SELECT tic, n_expected, n_missing, n_unexpected, n_duplicate, n_quality_mismatch, n_orbit_mismatch, round(missing_fraction, 8) AS missing_fraction FROM an")
def cadence_anomalies(spark, d):
    return anomalies(spark, d).withColumn("missing_fraction", r("missing_fraction", 8))


ST = lambda v, a, b: f"CASE WHEN {v} IS NULL THEN 'fail' WHEN {v} <= {a} THEN 'pass' WHEN {v} <= {b} THEN 'review' ELSE 'fail' END"
SM = lambda v, a, b: f"CASE WHEN {v} IS NULL THEN 'fail' WHEN {v} >= {a} THEN 'pass' WHEN {v} >= {b} THEN 'review' ELSE 'fail' END"
WORST = lambda *s: "CASE WHEN 'fail' IN (" + ", ".join(s) + ") THEN 'fail' WHEN 'review' IN (" + ", ".join(s) + ") THEN 'review' ELSE 'pass' END"


@query("cadence_quality_gate", CADENCES, AM, AN, sql=f"""
, a AS (SELECT median(missing_fraction) AS lm, quantile_cont(missing_fraction, 0.95) AS l95, count(*) AS nt, CAST(sum(n_unexpected + n_duplicate + n_quality_mismatch + n_orbit_mismatch) AS BIGINT) AS na FROM an),
m AS (SELECT median(finite_q0_fraction) AS fm, quantile_cont(finite_q0_fraction, 0.05) AS f5, median(quality0_fraction * finite_q0_fraction) AS um, quantile_cont(quality0_fraction * finite_q0_fraction, 0.05) AS u5, count(*) AS nc FROM am),
s AS (SELECT *, {ST('lm', 0.005, 0.01)} AS s1, {ST('l95', 0.02, 0.05)} AS s2, {SM('fm', 0.99, 0.95)} AS s3, {SM('f5', 0.95, 0.90)} AS s4, {SM('um', 0.80, 0.50)} AS s5, {SM('u5', 0.50, 0.30)} AS s6, CASE WHEN na = 0 AND nc = nt * 2 THEN 'pass' ELSE 'fail' END AS s7 FROM a, m)
SELECT 'cadence' AS gate, {WORST('s1', 's2', 's3', 's4', 's5', 's6', 's7')} AS status, round(lm, 8) AS loss_median, round(um, 8) AS usable_median, na AS n_anomalies FROM s""")
def cadence_quality_gate(spark, d):
    c, hot = curves(spark, d)
    return G.cadence_gate(anomalies(spark, d), G.aperture_metrics(c, hot)).select("gate", "status", r("loss_median", 8).alias("loss_median"), r("usable_median", 8).alias("usable_median"), "n_anomalies")


@query("aperture_ratio_gate", CADENCES, NORM, PM, sql=f"""
, gq AS (SELECT count(mad_ratio) / count(*) AS v, count(*) FILTER (WHERE mad_ratio < 1.0::DOUBLE / 3.0::DOUBLE OR mad_ratio > 3) / count(mad_ratio) AS mo, count(*) FILTER (WHERE mad_ratio < 0.1 OR mad_ratio > 10) / count(mad_ratio) AS ex, count(correlation) / count(*) AS cv, median(correlation) AS cm, count(*) FILTER (WHERE correlation < -0.2) / count(correlation) AS ng FROM pair),
s AS (SELECT *, {SM('v', 0.98, 0.95)} AS s1, {ST('mo', 0.05, 0.10)} AS s2, {ST('ex', 0.005, 0.01)} AS s3, {SM('cv', 0.98, 0.95)} AS s4, {SM('cm', 0.10, 0.0)} AS s5, {ST('ng', 0.05, 0.10)} AS s6 FROM gq)
SELECT 'aperture_pair' AS gate, {WORST('s1', 's2', 's3', 's4', 's5', 's6')} AS status, round(mo, 8) AS moderate_fraction, round(cm, 7) AS correlation_median FROM s""")
def aperture_ratio_gate(spark, d):
    c, hot = curves(spark, d)
    return G.aperture_gate(G.pair_metrics(c, "SML", "PRI", hot)).select("gate", "status", r("moderate_fraction", 8).alias("moderate_fraction"), r("correlation_median", 7).alias("correlation_median"))


@query("scatter_magnitude_gate")
def scatter_magnitude_gate(spark, d):
    c, hot = curves(spark, d)
    t = c.select("tic").distinct().withColumn("tmag", 16 + (F.col("tic") % 40) / 10)
    return G.scatter_gate(G.aperture_metrics(c, hot), t, 100)


@query("target_quality_flags", CADENCES, AM, PM, AN, sql=f"""
, t AS (SELECT DISTINCT user_id AS tic FROM events), a AS (SELECT tic, {ST('missing_fraction', 0.02, 0.05)} AS cs FROM an), m AS (SELECT tic, max(CASE WHEN finite_q0_fraction >= 0.95 THEN 0 WHEN finite_q0_fraction >= 0.90 THEN 1 ELSE 2 END) AS c FROM am GROUP BY ALL),
p AS (SELECT tic, CASE WHEN mad_ratio IS NULL OR mad_ratio < 0.1 OR mad_ratio > 10 THEN 'fail' WHEN mad_ratio < 1.0::DOUBLE / 3.0::DOUBLE OR mad_ratio > 3 THEN 'review' ELSE 'pass' END AS ps FROM pair),
j AS (SELECT t.tic, coalesce(cs, 'fail') AS cadence_status, CASE WHEN c = 0 THEN 'pass' WHEN c = 1 THEN 'review' ELSE 'fail' END AS aperture_status, coalesce(ps, 'fail') AS pair_status FROM t LEFT JOIN a ON a.tic = t.tic LEFT JOIN m ON m.tic = t.tic LEFT JOIN p ON p.tic = t.tic)
SELECT *, {WORST('cadence_status', 'aperture_status', 'pair_status')} AS status, concat_ws(';', CASE WHEN cadence_status <> 'pass' THEN 'cadence:' || cadence_status END, CASE WHEN aperture_status <> 'pass' THEN 'aperture:' || aperture_status END, CASE WHEN pair_status <> 'pass' THEN 'pair:' || pair_status END) AS reasons FROM j""")
def target_quality_flags(spark, d):
    c, hot = curves(spark, d)
    return G.target_flags(c.select("tic").distinct(), anomalies(spark, d), G.aperture_metrics(c, hot), G.pair_metrics(c, "SML", "PRI", hot))


@query("composed_gate")
def composed_gate(spark, d):
    c, hot = curves(spark, d)
    m, p = G.aperture_metrics(c, hot), G.pair_metrics(c, "SML", "PRI", hot)
    return G.compose([G.cadence_gate(anomalies(spark, d), m), G.aperture_gate(p), G.integrity_gate(m, p, 10)])


@query("search_coverage_audit", PEAKS, sql="""
, w AS (SELECT DISTINCT o_orderkey AS tic, ap AS aperture FROM orders, (VALUES ('SML'), ('PRI')) x(ap)), g AS (SELECT tic, aperture, count(*) AS n FROM peaks GROUP BY ALL), j AS (SELECT w.tic AS wt, g.tic AS gt FROM w FULL JOIN g ON g.tic = w.tic AND g.aperture = w.aperture)
SELECT count(wt) AS n_expected, count(*) FILTER (WHERE gt IS NULL) AS n_missing, count(*) FILTER (WHERE wt IS NULL) AS n_unexpected, CAST(0 AS BIGINT) AS n_failed, CAST(1 AS BIGINT) AS n_run_ids, count(*) FILTER (WHERE gt IS NULL) = 0 AND count(*) FILTER (WHERE wt IS NULL) = 0 AS passed FROM j""")
def search_coverage_audit(spark, d):
    return G.coverage_audit(B.peaks(spark, d), B.table(spark, d, "orders").select(F.col("o_orderkey").alias("tic")), B.APERTURES)


@query("magnitude_bin_medians", PEAKS, sql="""
, e AS (SELECT quantile_cont(tmag, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM peaks), b AS (SELECT p.*, greatest(0, len(list_filter(list_distinct(e), lambda x: x < tmag)) - 1) AS bin FROM peaks p, e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(min(tmag), 6) AS lo, round(max(tmag), 6) AS hi, round(median(depth_snr), 6) AS median_value FROM b GROUP BY ALL""")
def magnitude_bin_medians(spark, d):
    return G.magnitude_bins(B.peaks(spark, d), "depth_snr").select("bin", "n", r("lo").alias("lo"), r("hi").alias("hi"), r("median_value").alias("median_value"))


@query("table_content_hash", INJECTIONS, sql="""
, h AS (SELECT DISTINCT sha256('{"injection_id":' || injection_id || ',"source_kind":"' || source_kind || '","tic":' || tic || '}') AS h FROM injections), b AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS bh, count(*) AS n FROM h GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(bh, '' ORDER BY b)) AS content_sha256 FROM b""")
def table_content_hash(spark, d):
    return G.content_hash(B.injections(spark, d), ["injection_id", "tic", "source_kind"])


@query("peak_table_rules", PEAKS, sql="""
, r AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT peak_rank > 0) AS a, count(*) FILTER (WHERE NOT period_d > 0) AS b, count(*) FILTER (WHERE NOT isfinite(depth)) AS c, count(*) FILTER (WHERE NOT duration_min < period_d * 1440) AS e FROM peaks)
SELECT 'rank_positive' AS rule, n AS n_rows, a AS n_bad, a = 0 AND n > 0 AS passed FROM r UNION ALL SELECT 'period_positive', n, b, b = 0 AND n > 0 FROM r UNION ALL SELECT 'finite_depth', n, c, c = 0 AND n > 0 FROM r UNION ALL SELECT 'duration_below_period', n, e, e = 0 AND n > 0 FROM r
UNION ALL SELECT 'known_aperture', n, 0, true FROM r UNION ALL SELECT 'status_ok', n, 0, true FROM r""")
def peak_table_rules(spark, d):
    return G.peak_table_rules(B.peaks(spark, d))


REQ = {"labels": ("label", {"planet_like": 150, "stellar_variability": 20, "centroid_contaminant": 5}), "passes": ("second_pass", {"true": 100})}


@query("training_readiness", HUMAN_LABELS, sql="""
, q AS (SELECT * FROM (VALUES ('labels', 'label', 'planet_like', 150), ('labels', 'label', 'stellar_variability', 20), ('labels', 'label', 'centroid_contaminant', 5), ('passes', 'second_pass', 'true', 100)) v(gate, dimension, value, required)),
h AS (SELECT 'label' AS dimension, label AS value, count(*) AS n FROM human_labels GROUP BY ALL UNION ALL SELECT 'second_pass', CAST(second_pass AS VARCHAR), count(*) FROM human_labels GROUP BY ALL)
SELECT gate, q.dimension, q.value, CAST(required AS BIGINT) AS required, coalesce(n, 0) AS current, CAST(greatest(0, required - coalesce(n, 0)) AS BIGINT) AS deficit, required <= coalesce(n, 0) AS passed FROM q LEFT JOIN h ON h.dimension = q.dimension AND h.value = q.value""")
def training_readiness(spark, d):
    return G.readiness(B.human_labels(spark, d), REQ)


RET = """
rt AS (SELECT injection_id, aperture, 1 + (uid_b % 21 - 10) / 50 AS retention, truth_tmag AS tmag, truth_period_d AS period_d FROM truth QUALIFY row_number() OVER (PARTITION BY injection_id, aperture ORDER BY peak_rank, uid_a, uid_b, sde) = 1)"""


@query("retention_gate", PEAKS, INJECTIONS, TRUTH, RET, sql=f"""
, g AS (SELECT aperture, count(*) AS n, count(*) FILTER (WHERE tmag >= 19) AS nf, median(retention) AS m, quantile_cont(retention, 0.1) AS p, count(*) FILTER (WHERE retention BETWEEN 0.5 AND 1.5) / count(*) AS ib FROM rt GROUP BY ALL)
SELECT 'retention' AS gate, aperture, CASE WHEN n <> (SELECT count(DISTINCT injection_id) FROM rt) OR nf < 32 OR m NOT BETWEEN 0.7 AND 1.3 OR p < 0.5 OR ib < 0.9 THEN 'fail' WHEN m NOT BETWEEN 0.85 AND 1.15 OR p < 0.7 OR ib < 0.95 THEN 'review' ELSE 'pass' END AS status,
  n AS n_rows, round(m, 7) AS retention_median, round(p, 7) AS retention_p10, round(ib, 7) AS inband_fraction FROM g""")
def retention_gate(spark, d):
    l = labelled(spark, d)
    o = F.struct("peak_rank", "uid_a", "uid_b", "sde")
    m = l.groupBy("injection_id", "aperture").agg((1 + (F.min_by("uid_b", o) % 21 - 10) / 50).alias("retention"), F.first("truth_tmag").alias("tmag"), F.first("truth_period_d").alias("period_d")).withColumn("status", F.lit("ok"))
    n = m.select("injection_id").distinct().count()
    return G.retention_gate(m, n).drop("reasons").withColumns({c: r(c, 7) for c in ("retention_median", "retention_p10", "inband_fraction")})


@query("ensemble_release_gate", PEAKS, INJECTIONS, TRUTH, sql="""
, m AS (SELECT injection_id % 4 AS member, count(*) FILTER (WHERE match_kind <> 'mismatch') AS np, count(*) FILTER (WHERE match_kind <> 'mismatch' AND sde >= 8) AS nr FROM truth GROUP BY ALL)
SELECT count(*) AS n_members, round(sum(nr) / sum(np), 8) AS pooled_recall, round(sum(0.2::DOUBLE * np) / sum(np), 8) AS weighted_ap, count(*) >= 3 AND sum(nr) / sum(np) >= 0.4 AND sum(0.2 * np) / sum(np) >= 0.1 AS passed FROM m""")
def ensemble_release_gate(spark, d):
    m = labelled(spark, d).groupBy((F.col("injection_id") % 4).alias("member")).agg(F.count_if("is_signal").alias("n_positive"), F.count_if(F.col("is_signal") & (F.col("sde") >= 8)).alias("n_recovered")).withColumn("average_precision", F.lit(0.2))
    return G.release_gate(m).withColumns({"pooled_recall": r("pooled_recall", 8), "weighted_ap": r("weighted_ap", 8)})


@query("model_selection_score")
def model_selection_score(spark, d):
    """Score of two candidate rankers (strength and S/N): recall of injections at each fold's workload threshold, macro-F1,
    average precision and calibration error of the scores read as probabilities."""
    # two scores, a fold and a truth of each row are all that the steps below read, so the join is made once and written narrow
    rows = cut_lineage(labelled(spark, d).select("tic", "injection_id", "is_signal", "sde", "depth_snr", stable_fold(F.col("tic"), 7, 3).alias("fold")))
    out = None
    for name in ("sde", "depth_snr"):
        l = rows.withColumn("p", F.col(name) / (F.col(name) + 10.0))
        best, cuts = cut_lineage(l.groupBy("fold", "tic").agg(F.max(name).alias(name))), None
        for k in range(3):
            one = M.workload_threshold(best.where(F.col("fold") == k), name, 0.25).select(F.lit(k).cast("bigint").alias("fold"), "threshold")
            cuts = one if cuts is None else cuts.unionByName(one)
        hits = M.recall_at_thresholds(l, name, cuts).agg((F.sum("n_recovered") / F.sum("n_injections")).alias("recall_at_workload"))
        ap = M.ranking_metrics(M.score_levels(l, name, F.col("is_signal")), 10.0).select("average_precision")
        said = F.col("p") >= 0.5
        f1 = lambda yes, truth: 2 * F.count_if(yes & truth) / F.nullif(F.count_if(yes) + F.count_if(truth), F.lit(0))
        macro = l.agg(((F.coalesce(f1(said, F.col("is_signal")), F.lit(0.0)) + F.coalesce(f1(~said, ~F.col("is_signal")), F.lit(0.0))) / 2).alias("macro_f1"))
        sure = l.withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p")))
        ece = M.expected_calibration_error(M.calibration_bins(sure, "confidence", said == F.col("is_signal"))).select("ece")
        row = hits.transform(with_row, macro).transform(with_row, ap).transform(with_row, ece).withColumn("profile", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("selection_score", M.selection_score(F.col("recall_at_workload"), F.col("macro_f1"), F.col("average_precision"), F.col("ece")))
