"""Queries of review and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import consts as K
from lumensift.operators import metrics as M, review_tables as T, skew
from lumensift.plans.registry import query, r
from lumensift.plans.selection_queries import dg
from lumensift.plans.views import HUMAN_LABELS, INJECTIONS, PEAKS, QUEUE, RAW, SCORES
from lumensift.sources import binding as B

ANCHORS = """
am AS (SELECT review_id, 0 AS v, period_d * 1.5::DOUBLE AS ap, t0_bjd AS az, CASE WHEN review_id % 11 <> 0 THEN duration_min END AS ad, 'SML' AS aa, 8.5::DOUBLE AS sd FROM queue WHERE review_id % 4 < 2
  UNION ALL SELECT review_id, 1, CASE WHEN review_id % 13 <> 0 THEN period_d * 2 ELSE 0 END, t0_bjd + 1, duration_min, 'PRI', NULL FROM queue WHERE review_id % 6 = 0),
al AS (SELECT * FROM am QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY v DESC) = 1)"""


def anchors(q):
    k, p = F.col("review_id"), F.col("period_d")
    first = q.where(k % 4 < 2).select("review_id", (p * 1.5).alias("anchor_period_d"), F.col("t0_bjd").alias("anchor_t0_bjd"), F.when(k % 11 != 0, F.col("duration_min")).alias("anchor_duration_min"), F.lit("SML").alias("anchor_aperture"), F.lit(8.5).alias("anchor_sde"))
    second = q.where(k % 6 == 0).select("review_id", F.when(k % 13 != 0, p * 2).otherwise(0.0).alias("anchor_period_d"), (F.col("t0_bjd") + 1).alias("anchor_t0_bjd"), F.col("duration_min").alias("anchor_duration_min"), F.lit("PRI").alias("anchor_aperture"))
    return [first, second]


@query("display_ephemerides", QUEUE, ANCHORS, sql="""
, j AS (SELECT q.*, al.*, coalesce(ap > 0 AND az IS NOT NULL AND ad > 0, false) AS u FROM queue q LEFT JOIN (SELECT * EXCLUDE (review_id), review_id AS rid FROM al) al ON rid = q.review_id)
SELECT review_id, round(CASE WHEN u THEN ap ELSE period_d END, 8) AS display_period_d, round(CASE WHEN u THEN az ELSE t0_bjd END, 6) AS display_t0_bjd, CASE WHEN u THEN 'anchor' ELSE 'queue' END AS display_source,
  CASE WHEN u THEN aa ELSE '' END AS display_anchor_aperture, CASE WHEN u THEN sd END AS display_anchor_sde, round(abs(CASE WHEN u THEN ap ELSE period_d END - period_d) / period_d, 8) AS display_period_rel_delta FROM j""")
def display_ephemerides(spark, d):
    q = B.queue(spark, d)
    return T.display_ephemeris(q, anchors(q)).select("review_id", r("display_period_d", 8).alias("display_period_d"), r("display_t0_bjd").alias("display_t0_bjd"), "display_source", "display_anchor_aperture", "display_anchor_sde", r("display_period_rel_delta", 8).alias("display_period_rel_delta"))


@query("assembled_features", QUEUE, HUMAN_LABELS, ANCHORS, sql="""
SELECT q.review_id, label, round(ap, 8) AS anchor_period_d, aa AS anchor_aperture, sd AS anchor_sde, CASE WHEN q.review_id % 5 <> 0 THEN q.tmag * 2 END AS shape_a
FROM queue q JOIN human_labels h ON h.review_id = q.review_id LEFT JOIN al ON al.review_id = q.review_id""")
def assembled_features(spark, d):
    q = B.queue(spark, d)
    training = q.select("review_id", "tmag").join(B.human_labels(spark, d).select("review_id", "label"), "review_id")
    shape = q.where("review_id % 5 <> 0").select("review_id", (F.col("tmag") * 2).alias("shape_a"), F.lit(0.0).alias("label"))
    return T.assemble_features(training, shape, anchors(q)).select("review_id", "label", r("anchor_period_d", 8).alias("anchor_period_d"), "anchor_aperture", "anchor_sde", "shape_a")


MODES = ("bls_top1_recovered", "bls_recovered", "bls_topn_recovered", "bls_topn_harmonic_match", "not_recovered", "no_period_match")
DIAG = f"""
iq AS (SELECT *, CASE WHEN injection_id % 7 < 6 THEN {list(MODES)}[injection_id % 7 + 1] END AS recovery_mode FROM injections),
sv AS (SELECT injection_id, (injection_id % 44) / 2.0::DOUBLE AS snr FROM injections WHERE injection_id % 3 <> 0)"""


def _bins(c, edges):
    lit = lambda x: "'-inf'::DOUBLE" if x == -T.INF else "'inf'::DOUBLE" if x == T.INF else f"{x}::DOUBLE"
    return "CASE " + " ".join(f"WHEN {c} > {lit(a)} AND {c} <= {lit(b)} THEN {i}::BIGINT" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"


def diagnosed(spark, d):
    i, k = B.injections(spark, d), F.col("injection_id")
    q = i.withColumn("recovery_mode", F.get(F.array(*[F.lit(m) for m in MODES]), (k % 7).cast("int")))
    rows = i.where(k % 3 != 0).select("injection_id", F.explode(F.array(F.lit("SML"), F.lit("PRI"))).alias("aperture"))
    s = rows.withColumn("snr", F.when(F.col("aperture") == "SML", (k % 44) / F.lit(2.0)).otherwise(99.0))
    return q, T.joined_diagnostics(q, s, "SML")


@query("recovery_diagnostics", INJECTIONS, DIAG, sql=f"""
SELECT iq.injection_id, snr, {", ".join(f"{_bins(c, e)} AS {c}_bin" for c, e in T.FAILURE_BINS.items())},
  CASE WHEN recovery_mode IN {T.TOP1_MODES} THEN 'matched_top1' WHEN recovery_mode = 'bls_topn_recovered' THEN 'matched_exact_topn' WHEN recovery_mode = 'bls_topn_harmonic_match' THEN 'matched_harmonic_topn'
   WHEN snr < 7 THEN 'low_snr_unmatched' WHEN snr >= 7 THEN 'snr_qualified_ranking_loss' ELSE 'unknown_or_missing_snr' END AS failure_class FROM iq LEFT JOIN sv ON sv.injection_id = iq.injection_id""")
def recovery_diagnostics(spark, d):
    return diagnosed(spark, d)[1].select("injection_id", "snr", *[f"{c}_bin" for c in T.FAILURE_BINS], "failure_class")


@query("gate_columns_attached", INJECTIONS, sql="""
, g AS (SELECT injection_id, min(CAST(grid_radius_bin AS INTEGER)) AS recovery_cell_n, min(radius_rearth) AS tmag_gate FROM injections WHERE injection_id % 4 <> 1 GROUP BY ALL)
SELECT i.injection_id, round(i.tmag, 6) AS tmag, recovery_cell_n, tmag_gate FROM injections i LEFT JOIN g ON g.injection_id = i.injection_id""")
def gate_columns_attached(spark, d):
    i = B.injections(spark, d)
    gate = i.where("injection_id % 4 <> 1").select("injection_id", F.col("grid_radius_bin").cast("int").alias("recovery_cell_n"), F.col("radius_rearth").alias("tmag"))
    return T.attach_gate(i.select("injection_id", "tmag"), gate.unionByName(gate.withColumn("recovery_cell_n", F.col("recovery_cell_n") + 1)), ["recovery_cell_n", "tmag", "absent"]).withColumn("tmag", r("tmag"))


TARGETS = {"planet_like": "planet", "eclipsing_binary_or_pceb": "eb", "stellar_variability": "variable"}
NAMES = ("planet", "eb", "variable", "other")
TRANSFER = """
tr AS (SELECT s.review_id AS tic, rep_peak_rank AS peak_rank, CASE h.label WHEN 'planet_like' THEN 'planet' WHEN 'eclipsing_binary_or_pceb' THEN 'eb' WHEN 'stellar_variability' THEN 'variable' END AS target,
  CASE greatest(p_planet, p_eb, p_variable, p_other) WHEN p_planet THEN 'planet' WHEN p_eb THEN 'eb' WHEN p_variable THEN 'variable' ELSE 'other' END AS predicted
  FROM scores s JOIN human_labels h ON h.review_id = s.review_id WHERE s.review_id % 3 <> 0),
te AS (SELECT * FROM tr WHERE target IS NOT NULL)"""


def transferred(spark, d):
    s = B.scores(spark, d).select(F.col("review_id").alias("tic"), F.col("rep_peak_rank").alias("peak_rank"), *[f"p_{n}" for n in NAMES])
    rows = s.select("tic", "peak_rank").join(B.human_labels(spark, d).select(F.col("review_id").alias("tic"), F.col("label").alias("human_label")), "tic")
    return T.scored_transfer(rows.withColumn("scoring_eligible", F.col("tic") % 3 != 0), s, NAMES, TARGETS)


@query("scored_transfer", SCORES, HUMAN_LABELS, TRANSFER, sql="SELECT * FROM te")
def scored_transfer(spark, d):
    return transferred(spark, d).select("tic", "peak_rank", "target", "predicted")


@query("scored_transfer_metrics", SCORES, HUMAN_LABELS, TRANSFER, sql="""
, c AS (SELECT l AS label, count(*) FILTER (WHERE target = l AND predicted = l) AS tp, count(*) FILTER (WHERE target = l) AS support, count(*) FILTER (WHERE predicted = l) AS n_predicted FROM (SELECT target AS l FROM te UNION SELECT predicted FROM te), te GROUP BY ALL)
SELECT label, tp, support, n_predicted, round(coalesce(tp / nullif(support, 0), 0), 8) AS recall FROM c""")
def scored_transfer_metrics(spark, d):
    return M.class_metrics(M.confusion(transferred(spark, d), "target", "predicted"), "target", "predicted").select("label", "tp", "support", "n_predicted", r("recall", 8).alias("recall"))


STRONG = str(K.STRONG_LABELS)
TABLE = f"""
hq AS (SELECT q.review_id, source_kind, coalesce(label, '') AS human_label, CASE q.review_id % 3 WHEN 0 THEN 'bls_top1_recovered' WHEN 1 THEN 'other' END AS mode FROM queue q LEFT JOIN human_labels h ON h.review_id = q.review_id),
ht AS (SELECT *, row_number() OVER (PARTITION BY human_label, source_kind ORDER BY {dg(56, 'review_id')}, review_id) AS rk, count(*) OVER (PARTITION BY human_label, source_kind) AS n FROM hq WHERE human_label IN {STRONG}),
h1 AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(0.2::DOUBLE * n, 0)) ELSE round_even(0.2::DOUBLE * n, 0) END AS want FROM ht),
h2 AS (SELECT *, least(want, greatest(0, n - 1)) AS t, CASE WHEN n - want >= 3 THEN greatest(1, round_even(0.2::DOUBLE * n, 0)) ELSE round_even(0.2::DOUBLE * n, 0) END AS v0 FROM h1),
hs AS (SELECT review_id, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + least(v0, greatest(0, n - t - 1)) THEN 'validation' ELSE 'train' END AS split FROM h2)"""


@query("human_training_table", QUEUE, HUMAN_LABELS, TABLE, sql=f"""
SELECT hq.review_id, human_label, human_label <> '' AS is_labeled, coalesce(mode = 'bls_top1_recovered', false) AS bls_truth_match, human_label NOT IN ('', 'skip') AS audit_include,
  CASE WHEN human_label IN {STRONG} OR human_label = 'uncertain' THEN human_label ELSE '' END AS teacher_target, human_label IN {STRONG} AS teacher_include, coalesce(split, 'unlabeled_or_audit') AS training_split
FROM hq LEFT JOIN hs ON hs.review_id = hq.review_id""")
def human_training_table(spark, d):
    k = F.col("review_id")
    q = B.queue(spark, d).withColumns({"recovery_mode": F.when(k % 3 == 0, "bls_top1_recovered").when(k % 3 == 1, "other"), "injection_id": k})
    gate = q.select("injection_id", F.lit("open").alias("recovery_gate"))
    out = T.human_training_table(q, B.human_labels(spark, d), gate, ["recovery_gate"], 56)
    return out.select("review_id", "human_label", "is_labeled", "bls_truth_match", "audit_include", "teacher_target", "teacher_include", "training_split")


@query("merged_orbits", RAW, sql="SELECT tic, cadenceno, orbit AS orbitid, round(time, 6) AS time, row_number() OVER (PARTITION BY tic ORDER BY time, orbit, cadenceno) - 1 AS row_idx FROM raw_cadences")
def merged_orbits(spark, d):
    raw = B.raw_cadences(spark, d)
    return T.merge_orbits(raw, hot=skew.has_hot_group(B.table(spark, d, "events"), ["user_id"])).select("tic", "cadenceno", "orbitid", r("time").alias("time"), "row_idx")


@query("both_aperture_gate", PEAKS, sql="""
, b AS (SELECT aperture, sde, period_d, t0_bjd FROM peaks WHERE tic = 1 AND peak_rank = 1 AND aperture IN ('SML', 'PRI') QUALIFY row_number() OVER (PARTITION BY aperture ORDER BY sde DESC, period_d, t0_bjd DESC) = 1),
e AS (SELECT w.aperture, sde, period_d, abs(period_d / 1.5::DOUBLE - 1) AS pe, ((t0_bjd - 2457001.0::DOUBLE) / 1.5::DOUBLE + 0.5::DOUBLE) AS ph FROM (VALUES ('SML'), ('PRI')) w(aperture) LEFT JOIN b ON b.aperture = w.aperture),
f AS (SELECT *, abs(ph - floor(ph) - 0.5::DOUBLE) * 2160 AS em FROM e), g AS (SELECT *, coalesce(pe <= 5 AND sde >= 2 AND em <= 1000, false) AS passed FROM f)
SELECT aperture, round(period_d, 8) AS period_d, round(pe, 8) AS period_relative_error, round(em, 4) AS epoch_residual_min, passed, CASE WHEN period_d IS NULL THEN 'missing_top1' ELSE '' END AS reason, (SELECT bool_and(passed) FROM g) AS gate_passed FROM g""")
def both_aperture_gate(spark, d):
    g = T.both_aperture_gate(B.peaks(spark, d), 1, 1.5, 2457001.0, ("SML", "PRI"), 5.0, 2.0, 1000.0)
    return g.select("aperture", r("period_d", 8).alias("period_d"), r("period_relative_error", 8).alias("period_relative_error"), r("epoch_residual_min", 4).alias("epoch_residual_min"), "passed", "reason", "gate_passed")


@query("queue_value_summary", QUEUE, sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(quantile_cont({c}, 0.1), 8) AS q10, round(quantile_cont({c}, 0.5), 8) AS q50, round(quantile_cont({c}, 0.9), 8) AS q90 FROM queue" for c in ("period_d", "sde_max", "tmag")))
def queue_value_summary(spark, d):
    s = T.queue_summary(B.queue(spark, d), ["period_d", "sde_max", "tmag"], {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return s.select("column", "n", *[r(q, 8).alias(q) for q in ("q10", "q50", "q90")])
