"""Tables that reviews and trainings read: displayed ephemerides, features, diagnostics, scored transfers, labelled rows.

All joins are on a row, injection or (target, rank) id. Several rows for one id on the side that is attached are either an error or
reduced by a stated rule, so a join never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import metrics as M, ordered, robust
from lumensift.operators.skew import assert_unique, has_hot_group
from lumensift.operators.splits import stratified_splits

EPHEMERIS = ("period_d", "t0_bjd", "duration_min")
#: matched modes, strongest first, and the bins of failure reports (right-closed)
TOP1_MODES = ("bls_top1_recovered", "bls_recovered")
EXACT_MODES = (*TOP1_MODES, "bls_topn_recovered")
HARMONIC_MODE = "bls_topn_harmonic_match"
INF = float("inf")
FAILURE_BINS = {
    "snr": (-INF, 1.0, 3.0, 5.0, 7.0, 10.0, 20.0, INF), "tmag": (-INF, 16.0, 17.0, 18.0, 19.0, 20.0, INF), "truth_period_d": (0.0, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, INF),
    "model_depth": (0.0, 0.01, 0.03, 0.1, 0.3, 1.0, INF), "radius_rearth": (0.0, 1.0, 2.0, 4.0, 8.0, 11.2, 16.0, 25.0, INF)}


def _number(c: str, columns: Sequence[str]) -> Column:
    if c not in columns:
        return F.lit(None).cast("double")
    return robust.finite_or_null(F.col(c).cast("double"))


def last_rows(tables: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a key: that of the last table which has the key, with NULL for columns that table lacks; rows without a key are out."""
    parts = [t.select(*keys, F.lit(i).alias("_at"), F.struct(*[(F.col(c) if c in t.columns else F.lit(None)).cast("string").alias(c) for c in columns]).alias("_row")) for i, t in enumerate(tables)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return d.where(known).groupBy(*keys).agg(F.max(F.struct("_at", "_row")).alias("_m")).select(*keys, "_m._row.*")


def display_ephemeris(queue: DataFrame, metrics: Sequence[DataFrame] = (), key: str = "review_id") -> DataFrame:
    """The ephemeris that a sheet shows: the anchor's where the last metrics row has a whole one, else the queue's.

    Adds queue_* copies, display_* values, source, anchor aperture and strength, and the relative change of the period.
    """
    d = queue.withColumns({f"queue_{c}": _number(c, queue.columns) for c in EPHEMERIS})
    wanted = [*(f"anchor_{c}" for c in EPHEMERIS), "anchor_aperture", "anchor_sde"]
    if metrics:
        m = last_rows([t.withColumn(key, F.col(key).cast("string")) for t in metrics], [key], wanted).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in wanted])
        d = d.join(m, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")
    else:
        d = d.withColumns({f"_{c}": F.lit(None).cast("string") for c in wanted})
    num = lambda c: robust.finite_or_null(F.col(f"_anchor_{c}").cast("double"))
    d = d.withColumn("display_used_anchor", F.coalesce((num("period_d") > 0) & num("t0_bjd").isNotNull() & (num("duration_min") > 0), F.lit(False)))
    use = F.col("display_used_anchor")
    d = d.withColumns({**{f"display_{c}": F.when(use, num(c)).otherwise(F.col(f"queue_{c}")) for c in EPHEMERIS}, "display_source": F.when(use, "anchor").otherwise("queue"),
                       "display_anchor_aperture": F.when(use, F.coalesce("_anchor_aperture", F.lit(""))).otherwise(""), "display_anchor_sde": F.when(use, num("sde"))})
    base = F.abs("queue_period_d")
    return d.withColumn("display_period_rel_delta", F.when(base > 0, F.abs(F.col("display_period_d") - F.col("queue_period_d")) / base)).drop(*[f"_{c}" for c in wanted])


def assemble_features(training: DataFrame, shape: DataFrame | None, metrics: Sequence[DataFrame] = (), keys: Sequence[str] = ("row_id", "review_id")) -> DataFrame:
    """Training rows with the columns they lack from the metrics (last table wins) and the shape features, joined on all shared keys."""
    d = training
    if metrics:
        on = [k for k in keys if k in d.columns and all(k in m.columns for m in metrics)]
        new = list(dict.fromkeys(c for m in metrics for c in m.columns if c not in d.columns and c not in keys))
        kinds = {c: m.schema[c].dataType for m in reversed(metrics) for c in m.columns}
        if on and new:
            d = d.join(last_rows(metrics, on, new).select(*on, *[F.col(c).cast(kinds[c]).alias(c) for c in new]), on, "left")
    if shape is not None:
        on = [k for k in keys if k in d.columns and k in shape.columns]
        if not on:
            raise KeyError("shape features share no key with the training table")
        assert_unique(shape, on, "shape features")
        d = d.join(shape.select(*on, *[c for c in shape.columns if c not in d.columns]), on, "left")
    return d


def attach_gate(df: DataFrame, gate: DataFrame, columns: Sequence[str], key: str = "injection_id") -> DataFrame:
    """Gate columns by injection; of repeated gate rows the least one counts, names that clash get the suffix _gate."""
    have = [c for c in columns if c in gate.columns]
    g = gate.groupBy(key).agg(F.min(F.struct(*have)).alias("_g"))
    g = g.select(key, *[F.col(f"_g.{c}").alias(f"{c}_gate" if c in df.columns else c) for c in have])
    return df.join(g, key, "left")


def joined_diagnostics(queue: DataFrame, survival: DataFrame, aperture: str, recoverable_snr: float = 7.0, bins: dict[str, Sequence[float]] | None = None, key: str = "injection_id") -> DataFrame:
    """Injections with their signal's survival in one aperture, match flags, the five bins and the class of failure."""
    s = survival.where(F.col("aperture") == aperture)
    assert_unique(s, [key], "survival rows of the aperture")
    d = queue.join(s.select(key, *[c for c in s.columns if c not in queue.columns]), key, "left")
    mode = F.coalesce(F.col("recovery_mode"), F.lit(""))
    d = d.withColumns({"top1_recovered": mode.isin(*TOP1_MODES), "exact_recovered": mode.isin(*EXACT_MODES), "any_period_match": mode.isin(*EXACT_MODES, HARMONIC_MODE)})
    d = d.withColumns({f"{c}_bin": E.bin_index(_number(c, d.columns), e, "right") for c, e in (bins or FAILURE_BINS).items()})
    snr = _number("snr", d.columns)
    cls = (F.when(F.col("top1_recovered"), "matched_top1").when(F.col("exact_recovered"), "matched_exact_topn").when(F.col("any_period_match"), "matched_harmonic_topn")
           .when(snr < recoverable_snr, "low_snr_unmatched").when(snr >= recoverable_snr, "snr_qualified_ranking_loss").otherwise("unknown_or_missing_snr"))
    return d.withColumn("failure_class", cls)


def scored_transfer(rows: DataFrame, scores: DataFrame, classes: Sequence[str], targets: dict[str, str], label: str = "human_label") -> DataFrame:
    """Eligible labelled rows beside the prediction of the score table, joined on (tic, peak_rank); a row without a score is an error.

    ``targets`` maps labels to classes; other labels are not evaluated. Of equal probabilities the first class wins.
    """
    on = ["tic", "peak_rank"]
    e = rows.where(E.text_bool("scoring_eligible"))
    assert_unique(e, on, "rows")
    assert_unique(scores, on, "scores")
    p = [f"p_{c}" for c in classes]
    d = e.drop(*p).join(scores.select(*on, *p), on, "left")
    lost = d.where(" OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in p)).select(*on).limit(5).collect()
    if lost:
        raise ValueError(f"rows without a score: {[tuple(r) for r in lost]}")
    names = [x for pair in targets.items() for x in map(F.lit, pair)]
    d = d.withColumn("target", F.create_map(*names)[F.col(label)]).where("target IS NOT NULL")
    return M.score_predictions(d, dict(zip(classes, p)))


def human_training_table(queue: DataFrame, labels: DataFrame, gate: DataFrame | None, gate_columns: Sequence[str], seed: int, validation: float = 0.2, test: float = 0.2) -> DataFrame:
    """Every queue row with its label, truth match, flags, gate columns and split.

    Strong labels train; ``uncertain`` is for audits; ``skip`` is out. Training rows are split inside (target, source kind) strata by hash
    order, all others are ``unlabeled_or_audit``. Labels must be unique per review.
    """
    assert_unique(labels, ["review_id"], "labels")
    d = queue.join(labels.select("review_id", F.col("label").alias("human_label")), "review_id", "left").withColumn("human_label", F.coalesce("human_label", F.lit("")))
    if gate is not None:
        d = attach_gate(d, gate, gate_columns)
    lab = F.col("human_label")
    mode = F.coalesce(F.col("recovery_mode"), F.lit("")) if "recovery_mode" in d.columns else F.lit("")
    d = d.withColumns({"is_labeled": lab != "", "bls_truth_match": mode.isin(*K.TRUTH_MATCH_MODES), "human_strong_label": lab.isin(*K.STRONG_LABELS), "audit_include": ~lab.isin("", "skip"),
                       "teacher_target": E.label_target("human_label"), "teacher_include": lab.isin(*K.STRONG_LABELS)})
    train = d.where("teacher_include").select("review_id", "teacher_target", F.coalesce("source_kind", F.lit("")).alias("_kind"))
    split = stratified_splits(train, ["teacher_target", "_kind"], "review_id", validation, test, seed).select("review_id", F.col("split").alias("training_split"))
    return d.join(split, "review_id", "left").withColumn("training_split", F.coalesce("training_split", F.lit("unlabeled_or_audit")))


def merge_orbits(raw: DataFrame, keys: Sequence[str] = ("tic",), hot: bool = False) -> DataFrame:
    """Per-orbit rows of a target as one curve in time order, equal times in orbit and cadence order, each row with its orbit and place."""
    return ordered.with_row_index(raw.withColumnRenamed("orbit", "orbitid"), list(keys), ["time", "orbitid", "cadenceno"], "row_idx", hot)


def both_aperture_gate(peaks: DataFrame, tic: int, period: float, t0: float, apertures: Sequence[str], period_tol: float = 0.005, sde_min: float = 10.0, epoch_min: float = 30.0) -> DataFrame:
    """One row an aperture for a known object's strongest peak, and whether all apertures pass (``gate_passed`` on each row).

    An aperture without such a peak fails as ``missing_top1``. Of repeated top peaks the strongest counts.
    """
    top = peaks.where((F.col("tic") == tic) & (F.col("peak_rank") == 1) & F.col("aperture").isin(*apertures))
    top = top.groupBy("aperture").agg(F.max(F.struct(F.col("sde"), (-F.col("period_d")).alias("_p"), F.col("t0_bjd"))).alias("x")).select("aperture", "x.sde", (-F.col("x._p")).alias("period_d"), "x.t0_bjd")
    want = peaks.sparkSession.createDataFrame([(a,) for a in apertures], "aperture string")
    d = want.join(top, "aperture", "left")
    phase = (F.col("t0_bjd") - F.lit(float(t0))) / F.lit(float(period))
    d = d.withColumns({"period_relative_error": F.abs(F.col("period_d") / F.lit(float(period)) - 1), "epoch_residual_min": F.abs(F.pmod(phase + 0.5, F.lit(1.0)) - 0.5) * F.lit(float(period) * K.MIN_PER_DAY)})
    ok = F.coalesce((F.col("period_relative_error") <= period_tol) & (F.col("sde") >= sde_min) & ~F.isnan("sde") & (F.col("epoch_residual_min") <= epoch_min), F.lit(False))
    d = d.withColumns({"passed": ok, "reason": F.when(F.col("period_d").isNull(), "missing_top1").otherwise("")})
    return d.withColumn("gate_passed", F.bool_and("passed").over(W.partitionBy(F.lit(1))))  # a row an aperture


def queue_summary(df: DataFrame, columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """(column, n, quantiles) of the finite values of each column; a large table is narrowed by histograms in place of one sorted task."""
    hot, out = has_hot_group(df, []), None
    for c in columns:
        v = robust.finite_or_null(F.col(c).cast("double"))
        rows = df.select(F.lit(c).alias("column"), v.alias("v"))
        one = rows.groupBy("column").agg(F.count("v").alias("n")).join(robust.grouped_quantiles(rows, ["column"], F.col("v"), probs, hot), "column")
        out = one if out is None else out.unionByName(one)
    return out
