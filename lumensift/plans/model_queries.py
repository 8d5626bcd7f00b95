"""Queries of features, weights, models and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions.hashing import split_of
from lumensift.operators.ordering import cut_lineage
from lumensift.operators import metrics as M, models as D, recovery as R, vet as V
from lumensift.plans.recovery_queries import labelled
from lumensift.plans.registry import query, r
from lumensift.plans.views import HUMAN_LABELS, INJECTIONS, PEAKS, QUEUE, SCORES
from lumensift.sources import binding as B
from lumensift.operators.skew import has_hot_group, with_row

PROBS = {"planet": "p_planet", "eb": "p_eb", "variable": "p_variable", "other": "p_other"}
NAMES = list(PROBS)
PRED = """
pd0 AS (SELECT *, greatest(p_planet, p_eb, p_variable, p_other) AS confidence, CASE truth WHEN 0 THEN 'planet' WHEN 1 THEN 'eb' WHEN 2 THEN 'variable' ELSE 'other' END AS label FROM scores),
pred AS (SELECT *, CASE WHEN p_planet = confidence THEN 'planet' WHEN p_eb = confidence THEN 'eb' WHEN p_variable = confidence THEN 'variable' ELSE 'other' END AS predicted,
  confidence - list_sort([p_planet, p_eb, p_variable, p_other])[3] AS margin, -(p_planet * ln(p_planet) + p_eb * ln(p_eb) + p_variable * ln(p_variable) + p_other * ln(p_other)) AS nats FROM pd0)"""


def predictions(spark, d):
    s = B.scores(spark, d)
    label = F.when(F.col("truth") == 0, "planet").when(F.col("truth") == 1, "eb").when(F.col("truth") == 2, "variable").otherwise("other")
    return M.score_predictions(s, PROBS).withColumn("label", label)


@query("score_predictions", SCORES, PRED, sql="SELECT review_id, predicted, round(confidence, 8) AS confidence, round(margin, 8) AS margin, round(nats / ln(4), 8) AS entropy FROM pred")
def score_predictions(spark, d):
    return predictions(spark, d).select("review_id", "predicted", *[r(c, 8).alias(c) for c in ("confidence", "margin", "entropy")])


@query("confusion_matrix", SCORES, PRED, sql="SELECT label, predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, d):
    return M.confusion(predictions(spark, d), "label", "predicted")


PC = """
cl AS (SELECT label AS l FROM pred UNION SELECT predicted FROM pred), pc AS (SELECT l AS label, count(*) FILTER (WHERE label = l AND predicted = l) AS tp, count(*) FILTER (WHERE label = l) AS support, count(*) FILTER (WHERE predicted = l) AS n_predicted FROM cl, pred GROUP BY l),
pm AS (SELECT *, coalesce(tp / nullif(n_predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM pc), pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pm)"""


def per_class(spark, d):
    return M.class_metrics(M.confusion(predictions(spark, d), "label", "predicted"), "label", "predicted")


@query("class_metrics", SCORES, PRED, PC, sql="SELECT label, tp, support, n_predicted, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM pf")
def class_metrics(spark, d):
    return per_class(spark, d).withColumns({c: r(c, 8) for c in ("precision", "recall", "f1")})


@query("summary_metrics", SCORES, PRED, PC, sql="SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 8) AS accuracy, round(avg(recall), 8) AS balanced_accuracy, round(avg(f1), 8) AS macro_f1 FROM pf WHERE support > 0")
def summary_metrics(spark, d):
    return M.summary_metrics(per_class(spark, d)).withColumns({c: r(c, 8) for c in ("accuracy", "balanced_accuracy", "macro_f1")})


@query("calibration_error_by_fold", SCORES, PRED, sql="""
, b AS (SELECT fold, least(CAST(floor(confidence * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END) AS a FROM pred GROUP BY ALL)
SELECT fold, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(c - a)) / sum(n), 8) AS ece FROM b GROUP BY ALL""")
def calibration_error_by_fold(spark, d):
    b = M.calibration_bins(predictions(spark, d), "confidence", F.col("label") == F.col("predicted"), 10, ["fold"])
    return M.expected_calibration_error(b, ["fold"]).withColumn("ece", r("ece", 8))


LEV = """
lv AS (SELECT sde AS score, count(*) AS n, count(*) FILTER (WHERE sig) AS pos FROM (SELECT sde, match_kind <> 'mismatch' AS sig FROM truth) GROUP BY ALL),
lc AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos FROM lv WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def levels(spark, d):
    return M.score_levels(labelled(spark, d), "sde", F.col("is_signal"))


def _truth():
    from lumensift.plans.search_queries import TRUTH
    return TRUTH


TRUTH = _truth()


@query("ranking_metrics", PEAKS, INJECTIONS, TRUTH, LEV, sql="""
, t AS (SELECT sum(n) AS n, sum(pos) AS p FROM lc)
SELECT CAST(any_value(t.n) AS BIGINT) AS n, CAST(any_value(t.p) AS BIGINT) AS n_positive, round(sum(pos * cum_pos / cum_n) / any_value(t.p), 8) AS average_precision,
  round(sum(pos * ((t.n - t.p) - (cum_n - cum_pos) + (lc.n - pos) / 2)) / any_value(t.p * (t.n - t.p)), 8) AS roc_auc, round(sum(pos) FILTER (WHERE score >= 10) / sum(lc.n) FILTER (WHERE score >= 10), 8) AS precision_at_cut,
  round(sum(pos) FILTER (WHERE score >= 10) / any_value(t.p), 8) AS recall_at_cut FROM lc, t""")
def ranking_metrics(spark, d):
    return M.ranking_metrics(levels(spark, d), 10.0).withColumns({c: r(c, 8) for c in ("average_precision", "roc_auc", "precision_at_cut", "recall_at_cut")})


@query("review_budget_curve", PEAKS, INJECTIONS, TRUTH, LEV, sql="SELECT round(score, 6) AS score, round(cum_n / (SELECT sum(n) FROM lc), 8) AS reviewed_fraction, round(cum_pos / (SELECT sum(pos) FROM lc), 8) AS recall, round(cum_pos / cum_n, 8) AS precision FROM lc")
def review_budget_curve(spark, d):
    return M.budget_curve(levels(spark, d)).select(r("score").alias("score"), *[r(c, 8).alias(c) for c in ("reviewed_fraction", "recall", "precision")])


@query("value_at_budget", PEAKS, INJECTIONS, TRUTH, LEV, sql="SELECT round(max(cum_pos) / (SELECT sum(pos) FROM lc), 8) AS recall_at_budget, round(min(score), 6) AS threshold FROM lc WHERE cum_n / (SELECT sum(n) FROM lc) <= 0.05")
def value_at_budget(spark, d):
    return M.value_at_budget(M.budget_curve(levels(spark, d)), 0.05).select(r("recall_at_budget", 8).alias("recall_at_budget"), r("threshold").alias("threshold"))


@query("workload_threshold", PEAKS, sql="""
, t AS (SELECT tic, max(sde) AS s FROM peaks GROUP BY ALL), n AS (SELECT count(*) AS n, CAST(floor(0.05::DOUBLE * count(*)) AS BIGINT) AS k FROM t), l AS (SELECT s, sum(count(*)) OVER (ORDER BY s DESC) AS c FROM t GROUP BY s)
SELECT CAST(n AS INTEGER) AS n_targets, CAST(k AS INTEGER) AS max_pass, CAST(max(c) AS BIGINT) AS n_pass, round(min(s), 6) AS threshold FROM l, n WHERE c <= k GROUP BY n, k""")
def workload_threshold(spark, d):
    return M.workload_threshold(B.peaks(spark, d), "sde", 0.05).withColumn("threshold", r("threshold"))


@query("recall_at_fold_thresholds", PEAKS, INJECTIONS, TRUTH, sql="""
, f AS (SELECT *, injection_id % 5 AS fold FROM truth), t AS (SELECT fold, quantile_cont(sde, 0.5) AS thr FROM f GROUP BY ALL), h AS (SELECT f.fold, injection_id, bool_or(match_kind <> 'mismatch' AND sde >= thr) AS hit FROM f JOIN t ON t.fold = f.fold GROUP BY ALL)
SELECT fold, count(*) AS n_injections, count(*) FILTER (WHERE hit) AS n_recovered, round(count(*) FILTER (WHERE hit) / count(*), 8) AS recovery_fraction FROM h GROUP BY ALL""")
def recall_at_fold_thresholds(spark, d):
    l = labelled(spark, d).withColumn("fold", F.col("injection_id") % 5)
    t = l.groupBy("fold").agg(F.percentile("sde", 0.5).alias("threshold"))
    return M.recall_at_thresholds(l, "sde", t).withColumn("recovery_fraction", r("recovery_fraction", 8))


MEM = "mem AS (SELECT review_id, k, (p_planet + k * 0.01::DOUBLE * (review_id % 7)) AS p_planet, p_eb * (1 - k * 0.02::DOUBLE) AS p_eb, p_variable, p_other FROM scores, range(5) x(k))"


def members(spark, d):
    k = F.col("k")
    s = B.scores(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return s.withColumns({"p_planet": F.col("p_planet") + k * 0.01 * (F.col("review_id") % 7), "p_eb": F.col("p_eb") * (1 - k * 0.02)})


@query("ensemble_scores", SCORES, MEM, sql="""
, g AS (SELECT review_id, count(*) AS n_members, avg(p_planet) AS a, avg(p_eb) AS b, avg(p_variable) AS c, avg(p_other) AS e, (stddev_pop(p_planet) + stddev_pop(p_eb) + stddev_pop(p_variable) + stddev_pop(p_other)) / 4 AS ds FROM mem GROUP BY ALL)
SELECT review_id, n_members, round(a, 8) AS p_planet, round(ds, 8) AS disagreement, round(-(a * ln(a) + b * ln(b) + c * ln(c) + e * ln(e)), 8) AS entropy_nats, round(greatest(a, b, c, e), 8) AS confidence FROM g""")
def ensemble_scores(spark, d):
    e = M.ensemble(members(spark, d), list(PROBS.values()))
    return e.select("review_id", "n_members", *[r(c, 8).alias(c) for c in ("p_planet", "disagreement", "entropy_nats", "confidence")])


@query("ensemble_mean_spread", SCORES, MEM, sql="SELECT review_id, round(avg(p_eb), 8) AS p_mean, round(coalesce(stddev_samp(p_eb), 0), 8) AS p_std, round(max(p_eb), 8) AS p_max, count(*) AS n_members FROM mem GROUP BY ALL")
def ensemble_mean_spread(spark, d):
    return M.ensemble_scores(members(spark, d), "p_eb").withColumns({c: r(c, 8) for c in ("p_mean", "p_std", "p_max")})


@query("joined_score_tables", SCORES, sql="""
, b AS (SELECT review_id, CASE WHEN review_id % 20 = 3 THEN period_d + 0.1::DOUBLE ELSE period_d END AS pd, p_planet * 0.9::DOUBLE AS op FROM scores WHERE review_id % 15 <> 4)
SELECT s.review_id, CASE WHEN b.review_id IS NULL THEN 'left_only' WHEN s.review_id % 20 = 3 THEN 'identity_conflict' ELSE 'both' END AS state, round(op, 8) AS other_p_planet FROM scores s LEFT JOIN b ON b.review_id = s.review_id""")
def joined_score_tables(spark, d):
    s = B.scores(spark, d)
    k = F.col("review_id")
    b = s.where(k % 15 != 4).withColumns({"period_d": F.when(k % 20 == 3, F.col("period_d") + 0.1).otherwise(F.col("period_d")), "p_planet": F.col("p_planet") * 0.9})
    return M.join_score_tables(s, b, "review_id", ["period_d", "tic"], ["p_planet"]).select("review_id", "state", r("other_p_planet", 8).alias("other_p_planet"))


CW = """
cn AS (SELECT label, count(*) AS n FROM human_labels GROUP BY ALL), cw AS (SELECT label, n, least(2.0::DOUBLE, sqrt((SELECT max(n) FROM cn) / n)) AS w FROM cn), wm AS (SELECT sum(w * n) / sum(n) AS m FROM cw)"""


@query("class_weights", HUMAN_LABELS, CW, sql="SELECT review_id, h.label, round(w / m, 8) AS weight FROM human_labels h JOIN cw ON cw.label = h.label, wm")
def class_weights(spark, d):
    return M.class_weights(B.human_labels(spark, d), "label", 2.0).select("review_id", "label", r("weight", 8).alias("weight"))


@query("sample_loss_weights", QUEUE, HUMAN_LABELS, CW, sql="""
, j AS (SELECT h.review_id, h.label, source_kind = 'injected' AS inj, w / m AS w0 FROM human_labels h JOIN queue q ON q.review_id = h.review_id JOIN cw ON cw.label = h.label, wm),
t AS (SELECT label, sum(w0) FILTER (WHERE NOT inj) AS rt, sum(w0) FILTER (WHERE inj) AS it FROM j GROUP BY ALL), l AS (SELECT *, CASE WHEN label = 'planet_like' THEN rt ELSE 0.25 * rt END AS lim FROM t),
x AS (SELECT review_id, CASE WHEN inj AND rt > 0 AND it > lim THEN w0 * lim / it ELSE w0 END AS w1 FROM j JOIN l ON l.label = j.label)
SELECT review_id, round(w1 / (SELECT avg(w1) FROM x WHERE w1 > 0), 8) AS weight FROM x""")
def sample_loss_weights(spark, d):
    q = B.queue(spark, d).select("review_id", (F.col("source_kind") == "injected").alias("is_injected"))
    x = B.human_labels(spark, d).withColumnRenamed("label", "target").join(q, "review_id")
    return M.sample_weights(x, cap=2.0).select("review_id", r("weight", 8).alias("weight"))


@query("equalised_source_weights", QUEUE, sql="""
, t AS (SELECT stratum, sum(1.0::DOUBLE) AS t FROM queue WHERE stratum IN ('en', 'de') GROUP BY ALL)
SELECT review_id, round(CASE WHEN q.stratum IN ('en', 'de') THEN (SELECT avg(t) FROM t) / t.t ELSE 1 END, 8) AS weight FROM queue q LEFT JOIN t ON t.stratum = q.stratum""")
def equalised_source_weights(spark, d):
    q = B.queue(spark, d).withColumn("weight", F.lit(1.0))
    return M.equalise(q, "weight", F.when(F.col("stratum").isin("en", "de"), F.col("stratum"))).select("review_id", r("weight", 8).alias("weight"))


@query("pseudo_label_selection", SCORES, PRED, sql="SELECT review_id, predicted FROM pred WHERE confidence >= 0.3 AND margin >= 0.02 QUALIFY row_number() OVER (PARTITION BY predicted ORDER BY confidence DESC, review_id) <= 20")
def pseudo_label_selection(spark, d):
    return M.pseudo_labels(predictions(spark, d), 0.3, 0.02, 20).select("review_id", "predicted")


@query("review_priority_queue", SCORES, PRED, sql="""
, p AS (SELECT review_id, 0.65::DOUBLE * nats / ln(4) + 0.25::DOUBLE * (sde_max - (SELECT min(sde_max) FROM pred)) / (SELECT max(sde_max) - min(sde_max) FROM pred) + 0.10::DOUBLE * confidence AS pr FROM pred)
SELECT review_id, round(pr, 8) AS review_priority FROM p ORDER BY pr DESC, review_id LIMIT 100""")
def review_priority_queue(spark, d):
    return M.review_priority(predictions(spark, d), 100).select("review_id", r("review_priority", 8).alias("review_priority"))


@query("peak_features", PEAKS, sql="""
SELECT injection_id, aperture, peak_rank, uid_a, uid_b, round(log10(period_d), 8) AS log_period_d, round(log10(sde), 8) AS log_sde, round(1 / rank() OVER (PARTITION BY injection_id ORDER BY sde DESC), 8) AS sde_group_rank_inv,
  round(1 / rank() OVER (PARTITION BY injection_id ORDER BY abs(depth) DESC), 8) AS abs_depth_group_rank_inv, round(depth_snr / max(depth_snr) OVER (PARTITION BY injection_id), 8) AS depth_snr_over_group_max FROM peaks""")
def peak_features(spark, d):
    f = D.peak_features(B.peaks(spark, d), "injection_id")
    return f.select("injection_id", "aperture", "peak_rank", "uid_a", "uid_b", *[r(c, 8).alias(c) for c in ("log_period_d", "log_sde", "sde_group_rank_inv", "abs_depth_group_rank_inv", "depth_snr_over_group_max")])


@query("false_negative_audit", SCORES, PRED, sql="SELECT review_id, predicted, round(confidence, 8) AS confidence FROM pred WHERE label = 'planet' AND predicted <> 'planet' ORDER BY pred.confidence DESC, review_id LIMIT 40")
def false_negative_audit(spark, d):
    from lumensift.operators.labels import false_negatives
    return false_negatives(predictions(spark, d), "planet", 40).select("review_id", "predicted", r("confidence", 8).alias("confidence"))


@query("peak_ranker_recall")
def peak_ranker_recall(spark, d):
    """Train on the hash-train injections, rank the held-out ones, compare recall with the raw rank."""
    hot = has_hot_group(B.peaks(spark, d), ["injection_id"])
    l = labelled(spark, d).withColumn("split", split_of(F.col("injection_id")))
    m = D.train_peak_ranker(l.where("split = 'train'"), hot=hot)
    held = cut_lineage(D.rank_with(m, l.where("split <> 'train'"), hot=hot).select("injection_id", "is_signal", "peak_rank", "uid_a", "uid_b", "p_signal"))
    raw = R.recall_at_k(held, (1, 3, 5), ["peak_rank", "uid_a", "uid_b"]).withColumn("order", F.lit("rank"))
    new = R.recall_at_k(held, (1, 3, 5), [-F.col("p_signal"), F.col("peak_rank"), F.col("uid_a"), F.col("uid_b")]).withColumn("order", F.lit("ranker"))
    return raw.unionByName(new)


@query("recovery_boundary_model")
def recovery_boundary_model(spark, d):
    """Two-feature boundary of recovery; log-loss and AUC of its probabilities."""
    o = R.injection_outcomes(labelled(spark, d)).withColumn("observable", F.col("model_depth") * F.sqrt(F.col("n_good_in_transit").cast("double")))
    s, _ = D.logistic_boundary(cut_lineage(o), "topk", F.log(F.col("observable")), F.col("truth_tmag"))
    auc = M.ranking_metrics(M.score_levels(s, "p", F.col("topk"))).select("n", "n_positive", "roc_auc")
    return auc.transform(with_row, D.log_loss(s, "p", "topk"))
