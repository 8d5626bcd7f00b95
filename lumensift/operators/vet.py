"""Candidate filters, physical plausibility features and per-target ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions import consts as K, exprs as E


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order``. A struct minimum, combined map-side, so hot keys are fine.

    ``order`` must be ascending columns; negate numbers for descending.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    tie = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), tie).alias("_r"))
    return g.select(*keys, "_r.*").select(*df.columns)


def desc_last(c: Column | str) -> Column:
    """Sort key for descending order with missing values last, usable inside a struct minimum."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(-c.cast("double"), F.lit(float("inf")))


def regime_filter(df: DataFrame, p_min: float = 0.04, p_max: float = 13.0, sde_min: float = 7.0) -> DataFrame:
    return df.where((F.col("period_d") > p_min) & (F.col("period_d") < p_max) & (F.col("sde_max") > sde_min))


def top_targets(df: DataFrame, n: int, score: str = "sde_max", tie: Sequence[str] = ("period_d", "t0_bjd")) -> DataFrame:
    """Best row per target, then the ``n`` strongest targets (a bounded top-k, not a full sort)."""
    best = first_by(df, ["tic"], desc_last(score), *[F.col(c) for c in tie])
    return best.orderBy(F.desc_nulls_last(score), "tic").limit(n)


def pileup_bin(period: Column) -> Column:
    return F.floor(F.log10(period) / F.log10(F.lit(K.PILEUP_BASE)))


def vet_features(df: DataFrame, grid_max_min: float, p_alias_min: float = K.P_ALIAS_MIN_D,
                 rho_min: float = K.RHO_MIN_G_CM3) -> DataFrame:
    """Non-rejecting plausibility flags and one class per row.

    The population of each narrow period band is a small aggregate joined back, so a crowded band never
    gathers in one task.
    """
    d = df.withColumn("_pb", pileup_bin(F.col("period_d")))
    crowd = d.groupBy("_pb").agg(F.count(F.lit(1)).alias("period_cluster_count"))
    crowd = crowd.withColumnRenamed("_pb", "_pb2")
    d = d.join(crowd, F.col("_pb").eqNullSafe(F.col("_pb2"))).drop("_pb", "_pb2")  # rows without a usable period form a band of their own
    envelope = E.duration_envelope_min("period_d")
    roche = E.roche_period(rho_min)
    d = d.withColumns({
        "dur_envelope_min": envelope, "dur_grid_ceiling_hit": F.col("duration_min") >= grid_max_min,
        "dur_envelope_pass": (envelope >= grid_max_min) | (F.col("duration_min") <= envelope),
        "p_alias_pass": F.col("period_d") >= p_alias_min, "roche_pass": F.col("period_d") >= roche,
    })
    crowded = F.col("period_cluster_count") > K.PILEUP_LIMIT
    klass = (F.when(~F.col("dur_envelope_pass"), "duration_violator")
             .when(~F.col("p_alias_pass") | crowded, "alias_artifact")
             .when(F.col("dur_grid_ceiling_hit"), "pceb_grid_ceiling")
             .when(~F.col("roche_pass"), "sub_roche_pceb_suspect").otherwise("planet_candidate"))
    return d.withColumn("vet_class", klass)


def vetted_targets(clusters: DataFrame, grid_max_min: float, sde_min: float = 7.0) -> DataFrame:
    """Strongest cluster per target with features; the pass flag joins every plausibility cut."""
    best = first_by(clusters, ["tic"], desc_last("sde_max"), F.col("period_d"), F.col("t0_bjd"))
    f = vet_features(best, grid_max_min)
    ok = (F.col("vet_class") == "planet_candidate") & (F.col("sde_max") >= sde_min)
    return f.withColumn("vet_pass", ok)


def class_top(df: DataFrame, n: int, klass: str = "vet_class", score: str = "sde_max", tie: str = "tic") -> DataFrame:
    """Rank inside each class, first ``n`` kept; the rank filter is cut map-side before the shuffle."""
    w = W.partitionBy(klass).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn("class_rank", F.row_number().over(w)).where(F.col("class_rank") <= n)


def harmonic_keys(period: Column, factors: Sequence[float], tol: float) -> tuple[Column, Column]:
    """Band keys that turn a harmonic-period match into an equi join.

    Returns (array of structs {factor, band}) for the left period and the band of the right one. Bands are
    wider than the tolerance, so looking at the neighbouring bands finds every match.
    """
    width = 2.5 * tol
    band = lambda p: F.floor(F.log(p) / F.lit(width)).cast("bigint")
    left = F.flatten(F.array(*[F.array(*[F.struct(F.lit(float(f)).alias("factor"), (band(period * f) + k).alias("band"))
                                         for k in (-1, 0, 1)]) for f in factors]))
    return left, band


def harmonic_match(left: DataFrame, peaks: DataFrame, tol: float = K.PERIOD_TOL, factors: Sequence[float] = K.HARMONIC_FACTORS,
                   max_rank: int = 10, left_id: str = "review_id") -> DataFrame:
    """Best peak per left row whose period is a supported multiple within ``tol``.

    Peaks of equal period are reduced to their best rank first; the join key is (target, period band), so a
    target with very many rows on both sides only meets itself inside the tolerance band.
    """
    p = peaks.where(F.col("peak_rank") <= max_rank).groupBy("tic", "period_d").agg(F.min("peak_rank").alias("peak_rank"))
    cand, band = harmonic_keys(F.col("period_d"), factors, tol)
    lhs = left.select(left_id, "tic", F.col("period_d").alias("lp"), F.explode(cand).alias("h")).select(left_id, "tic", "lp", "h.factor", "h.band")
    rhs = p.select("tic", F.col("period_d").alias("match_period_d"), F.col("peak_rank").alias("match_rank"), band(F.col("period_d")).alias("band"))
    m = lhs.join(rhs, ["tic", "band"])
    err = F.abs(F.col("match_period_d") / F.col("lp") - F.col("factor")) / F.col("factor")
    m = m.withColumn("match_rel_err", err).where(F.col("match_rel_err") <= tol)
    order = F.struct("match_rel_err", "match_rank", "factor", "match_period_d")
    best = m.groupBy(left_id).agg(F.min(order).alias("b"), F.min(F.when(F.col("match_rank") == 1, F.struct("match_rel_err", "factor"))).alias("r1"))
    best = best.select(left_id, F.col("b.match_rel_err").alias("match_rel_err"), F.col("b.match_rank").alias("match_rank"),
                       F.col("b.factor").alias("match_factor"), F.col("b.match_period_d").alias("match_period_d"),
                       F.col("r1.factor").alias("rank1_factor"))
    return left.join(best, left_id, "left").withColumn(
        "match_status", F.when(F.col("match_rank").isNull(), "unmatched").when(F.col("rank1_factor").isNotNull(), "rank1").otherwise("topn"))


def label_transfer(labelled: DataFrame, peaks: DataFrame, tol: float = K.PERIOD_TOL, max_rank: int = 10,
                   max_scoring_rank: int = 5) -> DataFrame:
    """Carry each target's last label to its best exact-period peak; three-way status."""
    last = first_by(labelled, ["tic"], -F.col("review_id"))
    m = harmonic_match(last, peaks, tol, (1.0,), max_rank)
    status = (F.when(F.col("match_rank").isNull(), "no_period_match")
              .when(F.col("match_rank") <= max_scoring_rank, "transferred").otherwise("rank_too_deep"))
    return m.withColumn("transfer_status", status)


def label_transfer_windowed(labelled: DataFrame, peaks: DataFrame, tol: float = K.PERIOD_TOL,
                            min_overlap: float = K.MIN_WINDOW_OVERLAP, exempt: str = "stellar_variability") -> DataFrame:
    """Harmonic match that also needs overlapping windows (variability exempt); best by error, overlap, rank."""
    cand, band = harmonic_keys(F.col("period_d"), K.HARMONIC_FACTORS, tol)
    lhs = labelled.select("review_id", "tic", "label", F.col("period_d").alias("lp"), F.col("t0_bjd").alias("lt"), F.col("duration_min").alias("ld"),
                          F.explode(cand).alias("h")).select("review_id", "tic", "label", "lp", "lt", "ld", "h.factor", "h.band")
    rhs = peaks.select("tic", F.col("period_d").alias("pp"), F.col("t0_bjd").alias("pt"), F.col("duration_min").alias("pd"),
                       "peak_rank", "aperture", band(F.col("period_d")).alias("band"))
    m = lhs.join(rhs, ["tic", "band"]).withColumn("rel_err", F.abs(F.col("pp") / F.col("lp") - F.col("factor")) / F.col("factor"))
    m = m.where(F.col("rel_err") <= tol)
    m = m.withColumn("overlap", F.coalesce(E.window_overlap("pp", "pt", "pd", "lp", "lt", "ld")["fraction"], F.lit(0.0)))
    m = m.where((F.col("overlap") >= min_overlap) | (F.col("label") == exempt))
    key = F.struct("rel_err", (-F.col("overlap")).alias("no"), "peak_rank", "aperture", "pp", "pt", "pd", "factor")
    best = m.groupBy("review_id").agg(F.min(key).alias("b"))
    out = labelled.join(best, "review_id", "left")
    return out.select(*labelled.columns, F.col("b.rel_err").alias("rel_err"), (-F.col("b.no")).alias("overlap"), F.col("b.peak_rank").alias("peak_rank"),
                      F.col("b.factor").alias("factor"), F.col("b.aperture").alias("aperture"), F.col("b").isNotNull().alias("transferred"))


def truth_labelled(peaks: DataFrame, truth: DataFrame, tol: float = K.PERIOD_TOL, min_overlap: float = K.MIN_WINDOW_OVERLAP) -> DataFrame:
    """Peaks joined to their injection and classed exact, harmonic or mismatch."""
    t = truth.select("injection_id", "truth_period_d", "truth_t0_bjd", "truth_duration_min", "model_depth",
                     F.col("tmag").alias("truth_tmag"), "grid_period_bin", "grid_radius_bin", "n_good_in_transit")
    d = peaks.join(t, "injection_id")
    ov = E.window_overlap("period_d", "t0_bjd", "duration_min", "truth_period_d", "truth_t0_bjd", "truth_duration_min")
    d = d.withColumns({"_ov": ov, "_h": E.nearest_harmonic(F.col("period_d") / F.col("truth_period_d"))})
    limit = F.greatest(F.coalesce(F.col("truth_duration_min"), F.lit(20.0)), F.lit(20.0))
    d = d.withColumns({
        "period_rel_err": F.abs(F.col("period_d") - F.col("truth_period_d")) / F.col("truth_period_d"),
        "t0_phase_err_min": E.phase_minutes("t0_bjd", "truth_period_d", "truth_t0_bjd"),
        "nearest_harmonic_factor": F.col("_h.factor"), "harmonic_rel_err": F.col("_h.rel_err"),
        "window_delta_min": F.col("_ov.delta_min"), "window_overlap_fraction": F.col("_ov.fraction")})
    window = F.coalesce(F.col("window_overlap_fraction") >= min_overlap, F.lit(False))
    exact = window & (F.col("period_rel_err") <= tol) & (F.abs("t0_phase_err_min") <= limit)
    harm = (window & (F.abs(F.col("nearest_harmonic_factor") - 1) >= 1e-8) & (F.col("harmonic_rel_err") <= tol)
            & (F.abs("window_delta_min") <= limit))
    kind = F.when(exact, "exact").when(harm, "harmonic").otherwise("mismatch")
    return d.withColumn("match_kind", kind).withColumns({
        "exact_match": F.col("match_kind") == "exact", "harmonic_match": F.coalesce(harm, F.lit(False)),
        "is_signal": F.col("match_kind") != "mismatch"}).drop("_ov", "_h")


def anchor_context(peaks: DataFrame, anchor: str, context: str, n_anchor: int = 3, ids: Sequence[str] = ("tic",)) -> DataFrame:
    """Anchor-aperture peaks up to a rank with the other aperture's rank-1 fields beside them."""
    ids = list(ids)
    a = peaks.where((F.col("aperture") == anchor) & (F.col("peak_rank") <= n_anchor))
    ctx = first_by(peaks.where((F.col("aperture") == context) & (F.col("peak_rank") == 1)), ids, desc_last("sde"), F.col("period_d"), F.col("t0_bjd"))
    ctx = ctx.select(*ids, F.col("period_d").alias("ctx_period_d"), F.col("t0_bjd").alias("ctx_t0_bjd"), F.col("sde").alias("ctx_sde"))
    d = a.join(ctx, ids, "left")
    rel = E.period_relation(F.col("period_d"), F.col("ctx_period_d"))
    return d.withColumn("period_relation", rel).withColumn(
        "n_apertures_agree", F.when(F.col("period_relation").isin("exact", "harmonic"), 2).otherwise(1))


def two_aperture_pool(peaks: DataFrame, small: str, primary: str, n_small: int = 3, n_primary: int = 1) -> DataFrame:
    """Small peaks to rank 3 and primary to rank 1; a row's own values replace its rank-1 context."""
    top = lambda ap, p: first_by(peaks.where((F.col("aperture") == ap) & (F.col("peak_rank") == 1)), ["tic"], desc_last("sde"), F.col("period_d"), F.col("t0_bjd")) \
        .select("tic", F.col("period_d").alias(f"{p}_period_d"), F.col("sde").alias(f"{p}_sde"))
    keep = ((F.col("aperture") == small) & (F.col("peak_rank") <= n_small)) | ((F.col("aperture") == primary) & (F.col("peak_rank") <= n_primary))
    d = peaks.where(keep).join(top(small, "small"), "tic", "left").join(top(primary, "primary"), "tic", "left")
    own = lambda ap, p, c: F.when(F.col("aperture") == ap, F.col(c)).otherwise(F.col(f"{p}_{c}"))
    return d.withColumns({f"{p}_{c}": own(ap, p, c) for ap, p in ((small, "small"), (primary, "primary")) for c in ("period_d", "sde")})


def benchmark_recovery(peaks: DataFrame, period: float, t0: float, tol: float = 0.01, phase_min: float = 4.0, depth_min: float = 0.10,
                       sde_min: float = 15.0, rival_gap: float = 2.0, rival_period: float = 0.2) -> DataFrame:
    """Known-object audit per aperture: period (or half, double), phase, depth, strength, no short-period rival."""
    top = first_by(peaks.where("peak_rank = 1"), ["tic", "aperture"], desc_last("sde"), F.col("period_d"), F.col("t0_bjd"))
    rivals = peaks.where((F.col("peak_rank") > 1) & (F.col("period_d") < rival_period)).groupBy("tic", "aperture").agg(F.max("sde").alias("rival_sde"))
    d = top.join(rivals, ["tic", "aperture"], "left")
    ratio = F.col("period_d") / F.lit(period)
    near = (F.abs(ratio - 0.5) / 0.5 <= tol) | (F.abs(ratio - 1) <= tol) | (F.abs(ratio - 2) / 2 <= tol)
    d = d.withColumns({
        "period_pass": near, "phase_pass": F.abs(E.phase_minutes(F.col("t0_bjd"), F.lit(period), F.lit(t0))) <= phase_min,
        "depth_pass": F.col("depth") >= depth_min, "sde_pass": F.col("sde") >= sde_min,
        "rival_pass": F.coalesce(F.col("sde") - F.col("rival_sde") > rival_gap, F.lit(True))})
    flags = ["period_pass", "phase_pass", "depth_pass", "sde_pass", "rival_pass"]
    ok = F.lit(True)
    for f in flags:
        ok = ok & F.col(f)
    return d.withColumn("recovered", ok).select("tic", "aperture", *flags, "recovered")
