"""Queries of training rows, their contracts and folds, and of the grid that two apertures share."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import consts as K
from lumensift.operators import contracts as C, shared_grid as G, splits as S, training_rows as T
from lumensift.plans.cadence_queries import CLIP, MIN_ROWS, curves
from lumensift.plans.registry import query, r
from lumensift.plans.views import CADENCES, HUMAN_LABELS, INJECTIONS, PEAKS, QUEUE, SCORES
from lumensift.sources import binding as B

# --- one grid for two apertures ---------------------------------------------

#: Driver curves hold one row per half day, so boxes are hours wide.
GRID = G.SharedGrid(n_periods=120, p_min_d=1.0, p_max_d=9.0, durations_min=(120.0, 240.0, 360.0, 480.0, 600.0), min_cadences=MIN_ROWS)
W_D = "(120.0::DOUBLE / 1440.0)"
BOXES = (1, 2, 3, 4, 5)
SHARED = CLIP + f""",
sq AS (SELECT tic, aperture, time, CAST(round_even((y - 1) * 1e9, 0) AS BIGINT) AS yq FROM clean
  WHERE y IS NOT NULL AND (tic, aperture) IN (SELECT (tic, aperture) FROM g GROUP BY tic, aperture HAVING count(*) >= {MIN_ROWS})),
tz AS (SELECT tic, min(time) AS t_min FROM sq GROUP BY tic), sa AS (SELECT tic, aperture, count(*) AS n_all, CAST(sum(yq) AS BIGINT) AS s_all FROM sq GROUP BY ALL),
gr AS (SELECT i AS period_idx, floor(exp(ln(1.0::DOUBLE) + i * ((ln(9.0::DOUBLE) - ln(1.0::DOUBLE)) / 119)) * 1e9 + 0.5::DOUBLE) / 1e9 AS period_d FROM range(120) x(i)),
bn AS (SELECT q.tic, q.aperture, period_idx, period_d, CAST(floor(((q.time - t_min) % period_d) / {W_D}) AS BIGINT) AS bin, count(*) AS n, CAST(sum(yq) AS BIGINT) AS s
  FROM sq q JOIN tz ON tz.tic = q.tic, gr GROUP BY ALL),
wr AS (SELECT *, bin AS pos, 0 AS turn FROM bn UNION ALL SELECT *, bin + CAST(ceil(period_d / {W_D}) AS BIGINT) AS pos, 1 AS turn FROM bn WHERE bin < 4),
wn AS (SELECT *, {", ".join(f"CAST(sum(n) OVER w{k} AS BIGINT) AS n{k}, CAST(sum(s) OVER w{k} AS BIGINT) AS s{k}" for k in BOXES)} FROM wr
  WINDOW {", ".join(f"w{k} AS (PARTITION BY tic, aperture, period_idx ORDER BY pos RANGE BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)" for k in BOXES)}),
bx AS ({" UNION ALL ".join(f"SELECT tic, aperture, period_idx, n{k} AS n_in, s{k} AS s_in FROM wn WHERE turn = 0" for k in BOXES)}),
dp AS (SELECT b.*, ((s_all - s_in) / (n_all - n_in) - s_in / n_in) / 1e9 AS depth FROM bx b JOIN sa ON sa.tic = b.tic AND sa.aperture = b.aperture WHERE n_in < n_all),
pw AS (SELECT tic, aperture, period_idx, max(0.5::DOUBLE * n_in * depth * depth) AS power FROM dp WHERE depth > 0 GROUP BY ALL),
pm AS (SELECT *, power - median(power) OVER (PARTITION BY tic, aperture) AS x FROM pw),
ps AS (SELECT *, x / (1.4826::DOUBLE * median(abs(x)) OVER (PARTITION BY tic, aperture)) AS sde FROM pm),
al AS (SELECT tic, period_idx, period_d FROM (SELECT DISTINCT tic FROM cadences), gr)"""


@query("shared_grid_spectrum", CADENCES, SHARED, sql="""
SELECT al.tic, al.period_idx, round(log10(period_d), 8) AS log_period, round(a.power * 1e6, 6) AS power_small_u, round(b.power * 1e6, 6) AS power_primary_u, round(a.sde, 6) AS sde_small, round(b.sde, 6) AS sde_primary
FROM al LEFT JOIN ps a ON a.tic = al.tic AND a.period_idx = al.period_idx AND a.aperture = 'SML' LEFT JOIN ps b ON b.tic = al.tic AND b.period_idx = al.period_idx AND b.aperture = 'PRI'""")
def shared_grid_spectrum(spark, d):
    c, hot = curves(spark, d)
    s = G.shared_spectrum(c, "SML", "PRI", GRID, hot)
    return s.select("tic", "period_idx", r("log_period", 8).alias("log_period"), *[r(F.col(f"power_{a}") * 1e6).alias(f"power_{a}_u") for a in G.APERTURES], *[r(f"sde_{a}").alias(f"sde_{a}") for a in G.APERTURES])


# --- folds --------------------------------------------------------------------

@query("balanced_fold_audit", QUEUE, HUMAN_LABELS, sql="SELECT count(DISTINCT tic) AS n_groups, 0::BIGINT AS n_split, true AS within_bound FROM queue q JOIN human_labels h ON h.review_id = q.review_id")
def balanced_fold_audit(spark, d):
    rows = B.queue(spark, d).join(B.human_labels(spark, d), "review_id")
    a = S.balanced_assignment(rows, "tic", "label", 5, 56)
    return S.balance_report(a, 5).select("n_groups", "n_split", (F.col("imbalance") <= F.col("bound") + 1e-9).alias("within_bound"))


# --- rows -----------------------------------------------------------------------

def reviewed(spark, d):
    return B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", F.col("label").alias("human_label")), "review_id")


REVIEWED = "rv AS (SELECT q.*, h.label AS human_label FROM queue q JOIN human_labels h ON h.review_id = q.review_id)"


@query("input_availability", QUEUE, sql="""
SELECT q.review_id, c_custkey IS NOT NULL AS source_available, q.review_id % 9 <> 2 AND c_custkey IS NOT NULL AS native_input_include,
  CASE WHEN q.review_id % 9 = 2 THEN 'excluded_upstream' WHEN c_custkey IS NULL THEN 'missing_source' ELSE 'available' END AS input_status
FROM queue q LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1) c ON c_custkey = q.tic""")
def input_availability(spark, d):
    q = B.queue(spark, d).withColumn("native_input_include", F.when(F.col("review_id") % 9 == 2, "no").otherwise("yes"))
    have = B.table(spark, d, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("tic"))
    return T.mark_availability(q, have).select("review_id", "source_available", "native_input_include", "input_status")


@query("include_masks", QUEUE, sql="SELECT review_id, review_id % 3 = 0 OR review_id % 5 = 1 AS included FROM queue")
def include_masks(spark, d):
    k = F.col("review_id")
    q = B.queue(spark, d).withColumns({"morphology_include": F.when(k % 3 == 0, "True").when(k % 3 == 1, "0"), "harmonic_include": k % 5 == 1})
    return q.select("review_id", T.include_mask(q.columns).alias("included"))


PRIOR = REVIEWED + """,
pr AS (SELECT review_id, v AS version, CASE WHEN (review_id + v) % 5 = 0 THEN 'test' ELSE 'development' END AS fixed_split, CAST((review_id + v) % 5 AS INTEGER) AS cv_fold
  FROM rv, range(1, 3) x(v) WHERE human_label <> 'skip' AND (v = 1 OR review_id % 2 = 0))"""


def prior(spark, d):
    k = F.col("review_id") + F.col("version")
    rows = reviewed(spark, d).where("human_label <> 'skip'").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).where("version = 1 OR review_id % 2 = 0")
    return rows.select("review_id", "version", F.when(k % 5 == 0, "test").otherwise("development").alias("fixed_split"), (k % 5).cast("int").alias("cv_fold"))


@query("prior_split_carryover", QUEUE, HUMAN_LABELS, PRIOR, sql="""
, la AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY version DESC) = 1)
SELECT rv.review_id, fixed_split, cv_fold FROM rv LEFT JOIN la ON la.review_id = rv.review_id""")
def prior_split_carryover(spark, d):
    return T.attach_prior_splits(reviewed(spark, d), prior(spark, d), "version").select("review_id", "fixed_split", "cv_fold")


@query("prior_split_problems", QUEUE, HUMAN_LABELS, PRIOR, sql="SELECT review_id, human_label FROM rv WHERE human_label <> 'skip' AND review_id % 2 = 1")
def prior_split_problems(spark, d):
    return T.split_problems(reviewed(spark, d), prior(spark, d).where("version = 2"), "version")


ROLES = "ro AS (SELECT injection_id, tic, grid_period_bin * 5 + grid_radius_bin AS grid_cell_id, CASE WHEN injection_id % 5 = 0 THEN 'test' ELSE 'development' END AS fixed_split, CAST(injection_id % 5 AS INTEGER) AS cv_fold FROM injections)"


def roles(spark, d):
    k = F.col("injection_id")
    return B.injections(spark, d).select("injection_id", "tic", (F.col("grid_period_bin") * 5 + F.col("grid_radius_bin")).alias("grid_cell_id"),
                                         F.when(k % 5 == 0, "test").otherwise("development").alias("fixed_split"), (k % 5).cast("int").alias("cv_fold"))


@query("scoped_injection_truth", INJECTIONS, ROLES, sql="""
SELECT CAST(i.injection_id AS VARCHAR) AS injection_id, i.tic, n_good_in_transit, grid_cell_id, fixed_split FROM injections i JOIN ro ON ro.injection_id = i.injection_id WHERE i.injection_id % 3 = 0""")
def scoped_injection_truth(spark, d):
    return T.scoped_truth(roles(spark, d).where("injection_id % 3 = 0"), B.injections(spark, d)).select("injection_id", "tic", "n_good_in_transit", "grid_cell_id", "fixed_split")


@query("scope_conflicts", INJECTIONS, sql="""
SELECT CAST(injection_id AS VARCHAR) AS injection_id, CASE WHEN injection_id % 50 = 7 THEN 'repeated_role' WHEN injection_id % 40 = 3 THEN 'no_truth' ELSE 'differs_tic' END AS problem
FROM injections WHERE injection_id % 50 = 7 OR injection_id % 40 = 3 OR injection_id % 30 = 11""")
def scope_conflicts(spark, d):
    k, ro = F.col("injection_id"), roles(spark, d)
    ro = ro.withColumn("tic", F.when(k % 30 == 11, F.col("tic") + 1).otherwise(F.col("tic")))
    return T.scope_problems(ro.unionByName(ro.where(k % 50 == 7)), B.injections(spark, d).where(k % 40 != 3))


@query("eligible_schedule_gate", INJECTIONS, ROLES, sql="""
, c AS (SELECT grid_cell_id, count(*) FILTER (WHERE tic % 3 <> 0) AS n FROM ro GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_selected, count(*) AS expected_cells, count(*) FILTER (WHERE n > 0) AS n_cells, min(n) FILTER (WHERE n > 0) AS cell_min, max(n) AS cell_max, sum(n) >= 500 AND count(*) = count(*) FILTER (WHERE n > 0) AS passed FROM c""")
def eligible_schedule_gate(spark, d):
    reg = B.table(spark, d, "customer").select(F.col("c_custkey").alias("tic"), F.when(F.col("c_custkey") % 3 != 0, "yes").otherwise("no").alias("eligible"))
    return T.eligibility_gate(roles(spark, d), reg, "eligible", "grid_cell_id", 500)


@query("eligible_schedule", INJECTIONS, sql="SELECT injection_id, tic FROM injections WHERE tic % 3 <> 0")
def eligible_schedule(spark, d):
    reg = B.table(spark, d, "customer").select(F.col("c_custkey").alias("tic"), F.when(F.col("c_custkey") % 3 != 0, "yes").otherwise("no").alias("eligible"))
    return T.eligible_schedule(roles(spark, d), reg, "eligible").select("injection_id", "tic")


FACTORS = list(zip(K.HARMONIC_NAMES, ("0.25::DOUBLE", "(1.0::DOUBLE / 3.0)", "0.5::DOUBLE", "1.0::DOUBLE", "2.0::DOUBLE", "3.0::DOUBLE", "4.0::DOUBLE")))
CANDIDATES = ROLES + f""",
cd AS (SELECT p.injection_id * 10 + p.peak_rank AS review_id, p.injection_id, ro.fixed_split, ro.cv_fold, p.period_d / i.truth_period_d AS factor,
  {" ".join(f"CASE WHEN abs(p.period_d / i.truth_period_d / {f} - 1) <= 0.02::DOUBLE THEN {k} ELSE" for k, (_, f) in enumerate(FACTORS))} -1 {"END " * len(FACTORS)} AS h
  FROM (SELECT injection_id, peak_rank, min(period_d) AS period_d FROM peaks GROUP BY ALL) p JOIN injections i ON i.injection_id = p.injection_id JOIN ro ON ro.injection_id = p.injection_id),
cm AS (SELECT *, h >= 0 AND review_id % 13 <> 0 AS m FROM cd), ck AS (SELECT *, bool_or(m) OVER (PARTITION BY injection_id) AS found FROM cm)"""


def candidates(spark, d):
    p = B.peaks(spark, d).groupBy("injection_id", "peak_rank").agg(F.min("period_d").alias("period_d")).join(B.injections(spark, d).select("injection_id", "truth_period_d"), "injection_id")
    p = p.withColumns({"review_id": F.col("injection_id") * 10 + F.col("peak_rank"), "harmonic_factor": F.col("period_d") / F.col("truth_period_d")})
    near = F.array_min(F.array(*[F.abs(F.col("harmonic_factor") / f - 1) for f in K.HARMONIC_FACTORS])) <= K.PERIOD_TOL
    return p.select("review_id", "injection_id", "harmonic_factor", (near & (F.col("review_id") % 13 != 0)).alias("is_match"))


@query("injection_training_rows", INJECTIONS, PEAKS, CANDIDATES, sql=f"""
, o AS (SELECT CAST(review_id AS VARCHAR) AS review_id, injection_id, fixed_split, cv_fold, 'injected' AS input_variant, CASE WHEN m THEN 'compact_positive' ELSE 'same_lc_unmatched_peak' END AS training_role, CASE WHEN m THEN h ELSE -1 END AS hi FROM ck WHERE found
  UNION ALL SELECT review_id || ':paired_original', injection_id, fixed_split, cv_fold, 'paired_original', 'paired_pre_injection', -1 FROM ck WHERE m)
SELECT review_id, injection_id, fixed_split, cv_fold, input_variant, training_role, CAST(hi >= 0 AS INTEGER) AS compact_target_index, CAST(hi AS BIGINT) AS harmonic_target_index, coalesce({list(K.HARMONIC_NAMES)}[hi + 1], '') AS harmonic_target FROM o""")
def injection_training_rows(spark, d):
    return T.injection_rows(candidates(spark, d), roles(spark, d)).select("review_id", "injection_id", "fixed_split", "cv_fold", "input_variant", "training_role", "compact_target_index", "harmonic_target_index", "harmonic_target")


MORPHOLOGY, PRESERVE = ("compact_transit", "eclipse_contact", "smooth_variable", "other"), ("reject", "preserve")


@query("human_training_rows", QUEUE, HUMAN_LABELS, REVIEWED, sql=f"""
, t AS (SELECT review_id, CASE human_label WHEN 'planet_like' THEN 0 WHEN 'wide_transit_like' THEN 0 WHEN 'eclipsing_binary_or_pceb' THEN 1 WHEN 'stellar_variability' THEN 2 ELSE -1 END AS mi,
  CASE review_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS pi, CASE WHEN review_id % 2 = 0 AND review_id % 9 < 7 THEN review_id % 9 ELSE -1 END AS hi
  FROM rv WHERE source_kind <> 'injected' AND review_id % 10 <> 4 AND human_label <> 'skip' AND NOT (review_id % 7 = 0 AND human_label IN {T.SIGNALS}))
SELECT review_id, CAST(mi AS BIGINT) AS morphology_target_index, CAST(pi AS BIGINT) AS preserve_target_index, CAST(hi AS BIGINT) AS harmonic_target_index FROM t WHERE greatest(mi, pi, hi) >= 0""")
def human_training_rows(spark, d):
    k, lab = F.col("review_id"), F.col("human_label")
    rows = reviewed(spark, d).withColumns({
        "ephemeris_status": F.when(k % 7 == 0, "unresolved"),
        "morphology_target": F.when(lab.isin("planet_like", "wide_transit_like"), "compact_transit").when(lab == "eclipsing_binary_or_pceb", "eclipse_contact").when(lab == "stellar_variability", "smooth_variable"),
        "preserve_target": F.when(k % 3 == 0, "preserve").when(k % 3 == 1, "reject"), "harmonic_include": F.when(k % 2 == 0, "yes").otherwise("no"),
        "harmonic_target": F.get(F.array(*[F.lit(n) for n in K.HARMONIC_NAMES]), (k % 9).cast("int"))})
    transfer = rows.select("review_id", F.when(k % 10 != 4, "1").otherwise("0").alias("transfer_ok"))
    return T.human_rows(rows, MORPHOLOGY, PRESERVE, transfer).select("review_id", "morphology_target_index", "preserve_target_index", "harmonic_target_index")


@query("fold_training_weights", QUEUE, HUMAN_LABELS, REVIEWED, sql="""
, b AS (SELECT review_id, CASE WHEN review_id % 11 < 7 THEN 0 WHEN review_id % 11 < 9 THEN 1 WHEN review_id % 11 < 10 THEN 2 ELSE -1 END AS t, source_kind = 'injected' AS i, human_label = 'planet_like' AS e, review_id % 5 <> 0 AS fit FROM rv),
f AS (SELECT * FROM b WHERE fit AND t >= 0), sz AS (SELECT t, count(*) AS c FROM f GROUP BY ALL), w0 AS (SELECT t, c, least(1.5::DOUBLE, sqrt((SELECT max(c) FROM sz) / c)) AS w FROM sz),
f1 AS (SELECT f.*, w0.w / (SELECT sum(w * c) / sum(c) FROM w0) AS w FROM f JOIN w0 ON w0.t = f.t),
f2 AS (SELECT *, sum(CASE WHEN i THEN 0 ELSE w END) OVER (PARTITION BY t) * CASE WHEN e THEN 1 ELSE 0.25::DOUBLE END AS lim, sum(CASE WHEN i THEN w ELSE 0 END) OVER (PARTITION BY t, e) AS tot FROM f1),
f3 AS (SELECT review_id, CASE WHEN i AND lim > 0 AND tot > lim THEN w * lim / tot ELSE w END AS w FROM f2)
SELECT b.review_id, round(coalesce(f3.w / (SELECT avg(w) FROM f3 WHERE w > 0), 0), 8) AS preserve_weight FROM b LEFT JOIN f3 ON f3.review_id = b.review_id""")
def fold_training_weights(spark, d):
    k = F.col("review_id")
    rows = reviewed(spark, d).withColumns({"preserve_target_index": F.when(k % 11 < 7, 0).when(k % 11 < 9, 1).when(k % 11 < 10, 2).otherwise(-1), "is_injected_row": F.col("source_kind") == "injected"})
    return T.fold_weights(rows, k % 5 != 0, {"preserve_target_index": "preserve_weight"}, cap=1.5).select("review_id", r("preserve_weight", 8).alias("preserve_weight"))


NAMES = ("planet", "eb", "variable", "other")
LOCKED = """
lk AS (SELECT review_id, CASE truth WHEN 0 THEN 'planet' WHEN 1 THEN 'eb' WHEN 2 THEN 'variable' ELSE 'other' END AS label, p_planet, p_eb, p_variable, p_other, greatest(p_planet, p_eb, p_variable, p_other) AS m FROM scores WHERE review_id % 5 = 0 AND review_id % 7 <> 3),
lj AS (SELECT review_id, label, CASE m WHEN p_planet THEN 'planet' WHEN p_eb THEN 'eb' WHEN p_variable THEN 'variable' ELSE 'other' END AS new_predicted,
  CASE m WHEN p_other THEN 'planet' WHEN p_eb THEN 'eb' WHEN p_variable THEN 'variable' ELSE 'other' END AS old_predicted FROM lk),
lc AS (SELECT l, v, count(*) FILTER (WHERE label = l) AS s, count(*) FILTER (WHERE p = l) AS k, count(*) FILTER (WHERE label = l AND p = l) AS tp
  FROM (VALUES ('planet'), ('eb'), ('variable'), ('other')) c(l), (SELECT label, new_predicted AS p, 'new' AS v FROM lj UNION ALL SELECT label, old_predicted, 'old' FROM lj) GROUP BY ALL),
lf AS (SELECT *, CASE WHEN s > 0 THEN tp / s END AS rec, CASE WHEN tp > 0 THEN 2 * (tp / k) * (tp / s) / (tp / k + tp / s) ELSE 0 END AS f1 FROM lc WHERE s > 0)"""


def locked(spark, d):
    s, k = B.scores(spark, d), F.col("review_id")
    rows = s.select("review_id", F.when(k % 5 == 0, "test").otherwise("development").alias("fixed_split"), F.when(k % 7 == 3, "other_role").otherwise("real_human_morphology").alias("training_role"), F.col("truth").alias("morphology_target_index"))
    old = s.select("review_id", F.col("p_other").alias("p_planet"), "p_eb", "p_variable", F.col("p_planet").alias("p_other"))
    return T.locked_rows(rows, s, old, NAMES)


@query("locked_holdout_rows", SCORES, LOCKED, sql="SELECT * FROM lj")
def locked_holdout_rows(spark, d):
    return locked(spark, d).select("review_id", "label", "new_predicted", "old_predicted")


@query("locked_holdout_comparison", SCORES, LOCKED, sql="""
, x AS (SELECT (SELECT count(*) FROM lj) AS n, avg(f1) FILTER (WHERE v = 'new') AS a, avg(f1) FILTER (WHERE v = 'old') AS b, min(rec) FILTER (WHERE v = 'new' AND l <> 'planet') AS rc FROM lf)
SELECT n, round(a, 8) AS new_macro_f1, round(b, 8) AS old_macro_f1, round(a - b, 8) AS delta, round(rc, 8) AS min_required_recall, a - b >= -0.03::DOUBLE AND rc >= 0.6::DOUBLE AS passed FROM x""")
def locked_holdout_comparison(spark, d):
    c = T.compare_locked(locked(spark, d), NAMES[1:])
    return c.select("n", *[r(x, 8).alias(x) for x in ("new_macro_f1", "old_macro_f1", "delta", "min_required_recall")], "passed")


# --- contracts --------------------------------------------------------------------

PAIR = C.PairContract(("SML", "PRI"))
CONTRACT = """
mt AS (SELECT review_id, 0 AS v, CASE WHEN review_id % 6 = 5 THEN 'PRI' ELSE 'SML' END AS anchor_aperture, period_d AS anchor_period_d, t0_bjd AS anchor_t0_bjd, duration_min AS anchor_duration_min, period_d AS small_period_d, sde_max AS small_sde,
    CASE WHEN review_id % 7 <> 0 THEN period_d END AS primary_period_d, 5.0::DOUBLE AS primary_sde, (review_id % 5) / 100.0::DOUBLE AS delta FROM queue WHERE review_id % 10 < 8
  UNION ALL SELECT review_id, 1, 'SML', period_d, t0_bjd, duration_min, period_d * 1.005::DOUBLE, 2.0::DOUBLE, period_d, 9.0::DOUBLE, 0.01::DOUBLE FROM queue WHERE review_id % 3 = 0),
ml AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY v DESC) = 1),
cf AS (SELECT q.review_id, CASE WHEN q.review_id % 4 = 0 THEN 2 * q.period_d ELSE q.period_d END AS shown, ml.* EXCLUDE (review_id), coalesce(anchor_aperture = 'SML', false) AS sok FROM queue q LEFT JOIN ml ON ml.review_id = q.review_id),
cg AS (SELECT *, coalesce(abs(shown / small_period_d - 1) <= 0.01::DOUBLE, false) AS dok, coalesce(primary_period_d > 0, false) AS pok FROM cf)"""


def contract(spark, d):
    q, k = B.queue(spark, d), F.col("review_id")
    base = q.withColumns({"display_period_d": F.when(k % 4 == 0, 2 * F.col("period_d")).otherwise(F.col("period_d")), "main_include": F.when(k % 2 == 0, "true").otherwise("false"), "training_split": F.lit("train"),
                          "queue_rank": k, "sml_depth": F.lit(0.1), "raw_flux_best": F.lit(1.0)})
    def metrics(rows, aperture, small, sde, primary, psde, delta):
        return rows.select("review_id", aperture.alias("anchor_aperture"), F.col("period_d").alias("anchor_period_d"), F.col("t0_bjd").alias("anchor_t0_bjd"), F.col("duration_min").alias("anchor_duration_min"),
                           small.alias("small_period_d"), sde.alias("small_sde"), primary.alias("primary_period_d"), F.lit(psde).alias("primary_sde"), delta.alias("aperture_period_rel_delta"))
    p = F.col("period_d")
    first = metrics(q.where(k % 10 < 8), F.when(k % 6 == 5, "PRI").otherwise("SML"), p, F.col("sde_max"), F.when(k % 7 != 0, p), 5.0, (k % 5) / F.lit(100.0))
    second = metrics(q.where(k % 3 == 0), F.lit("SML"), p * 1.005, F.lit(2.0), p, 9.0, F.lit(0.01))
    return C.contract_frame(base, C.latest_metrics([first, second], PAIR), PAIR)


@query("contract_training_frame", QUEUE, CONTRACT, sql="""
SELECT CAST(review_id AS VARCHAR) AS review_id, sok AND dok AND pok AS review_ok, CASE WHEN NOT sok THEN 'missing_small_anchor' WHEN NOT dok THEN 'display_not_small_anchor' WHEN NOT pok THEN 'missing_primary_supplement' ELSE '' END AS exclusion_reason,
  round(anchor_period_d, 8) AS period_d, CASE WHEN NOT pok THEN 0 WHEN delta <= 0.02::DOUBLE THEN 2 ELSE 1 END AS n_apertures_agree, CASE WHEN pok AND delta <= 0.02::DOUBLE THEN 'SML,PRI' WHEN sok THEN 'SML' ELSE '' END AS apertures_agree,
  round(least(small_sde, primary_sde), 8) AS min_pair_sde, review_id % 2 = 0 AND sok AND dok AND pok AS main_include, CASE WHEN sok AND dok AND pok THEN 'train' ELSE 'unlabeled_or_audit' END AS training_split,
  round(CASE WHEN sok THEN shown END, 8) AS display_period_d FROM cg""")
def contract_training_frame(spark, d):
    C.require_pair(["SML", "PRI"], PAIR)
    out = contract(spark, d)
    return out.select("review_id", "review_ok", "exclusion_reason", r("period_d", 8).alias("period_d"), "n_apertures_agree", "apertures_agree", r("min_pair_sde", 8).alias("min_pair_sde"), "main_include", "training_split", r("display_period_d", 8).alias("display_period_d"))


@query("contract_violations", QUEUE, CONTRACT, sql="SELECT CAST(review_id AS VARCHAR) AS review_id, 'not_ok' AS problem FROM cg WHERE NOT (sok AND dok AND pok) AND review_id % 8 = 0")
def contract_violations(spark, d):
    out = contract(spark, d)
    return C.contract_problems(out.withColumn("main_include", F.col("main_include") | (F.col("review_id").cast("bigint") % 8 == 0)), PAIR)
