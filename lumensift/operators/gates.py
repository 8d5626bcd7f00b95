"""Pass/review/fail gates. Missing evidence fails: every status function maps NULL to fail."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import cadence, robust
from lumensift.operators.cadence import CURVE
from lumensift.operators.skew import with_row

# fixed gate limits: (pass, review)
SCATTER_FINITE = (0.98, 0.95)
SCATTER_SLOPE = (-0.10, 0.60, -0.20, 0.80)
SCATTER_OUTLIERS = (0.05, 0.10)
HIGH_RESIDUAL_DEX = 0.50
LOSS_MEDIAN, LOSS_P95 = (0.005, 0.01), (0.02, 0.05)
FINITE_MEDIAN, FINITE_P05 = (0.99, 0.95), (0.95, 0.90)
USABLE_MEDIAN, USABLE_P05 = (0.80, 0.50), (0.50, 0.30)
RATIO_MODERATE, RATIO_EXTREME = (1.0 / 3.0, 3.0), (0.10, 10.0)
MODERATE_OUTLIERS, EXTREME_OUTLIERS = (0.05, 0.10), (0.005, 0.01)
VALID_FRACTION, CORRELATION_VALID, CORRELATION_MEDIAN = (0.98, 0.95), (0.98, 0.95), (0.10, 0.0)
NEGATIVE_CORRELATION, NEGATIVE_FRACTION = -0.20, (0.05, 0.10)
RETENTION = (0.85, 1.15, 0.70, 1.30)
RETENTION_P10, INBAND = (0.70, 0.50), (0.95, 0.90)
MAGNITUDE_EDGES = (0.0, 18.0, 19.0, 19.5, 20.0, 20.5, 30.0)


def aperture_metrics(cadences: DataFrame, hot: bool = False) -> DataFrame:
    """Per curve: rows, good share, finite share of good rows, MAD ppm and twice-clipped RMS ppm."""
    d = cadences
    fin = robust.finite(F.col("flux"))
    g = d.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("n_cadences"), F.avg((F.col("quality") == 0).cast("double")).alias("quality0_fraction"),
                              (F.count_if((F.col("quality") == 0) & fin) / F.nullif(F.count_if(F.col("quality") == 0), F.lit(0))).alias("finite_q0_fraction"),
                              F.avg((F.col("flux") < 0).cast("double")).alias("negative_fraction"))
    y = cadence.normalise(cadence.good_cadences(d), hot)
    mm = robust.median_mad(y, CURVE, F.col("y"), hot, "_m", "_d").select(*CURVE, (K.MAD_SIGMA * F.col("_d") * 1e6).alias("mad_ppm"))
    rms = robust.clipped_rms(y, CURVE, F.col("y"), 5.0, 2, hot).select(*CURVE, (F.col("clipped_rms") * 1e6).alias("rms5_ppm"))
    return g.join(mm, CURVE, "left").join(rms, CURVE, "left")


def pair_metrics(cadences: DataFrame, small: str, primary: str, hot: bool = False) -> DataFrame:
    """Per target: correlation and difference MAD of the two normalised apertures on common good rows, and the MAD ratio."""
    y = cadence.normalise(cadence.good_cadences(cadences), hot)
    p = y.groupBy("tic", "cadenceno").agg(F.max(F.when(F.col("aperture") == small, F.col("y"))).alias("s"), F.max(F.when(F.col("aperture") == primary, F.col("y"))).alias("p"))
    p = p.where("s IS NOT NULL AND p IS NOT NULL").withColumn("_d", F.col("p") - F.col("s"))
    g = p.groupBy("tic").agg(F.count(F.lit(1)).alias("n_common"), F.corr("s", "p").alias("correlation"))
    for c, n in (("_d", "diff"), ("s", "small"), ("p", "primary")):
        m = robust.median_mad(p, ["tic"], F.col(c), hot, "_m", "_v").select("tic", (K.MAD_SIGMA * F.col("_v") * 1e6).alias(f"{n}_mad_ppm"))
        g = g.join(m, "tic", "left")
    return g.withColumn("mad_ratio", F.col("primary_mad_ppm") / F.nullif("small_mad_ppm", F.lit(0.0)))


def cadence_anomalies(cadences: DataFrame, reference: DataFrame, hot: bool = False) -> DataFrame:
    """Per target against the authority: expected, missing, unexpected, duplicate, quality and orbit disagreements.

    A reference with apertures is held against every aperture's own cadences; the target's counts are their sums.
    """
    on = [c for c in ("tic", "aperture", "cadenceno") if c in reference.columns]
    obs = cadences.groupBy(*on).agg(F.count(F.lit(1)).alias("k"), F.max("quality").alias("quality"), F.max("orbitid").alias("orbitid"))
    r = reference.select(*on, F.col("quality").alias("_q"), F.col("orbitid").alias("_o")).withColumn("_r", F.lit(True))
    j = obs.withColumn("_l", F.lit(True)).join(r, on, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    g = j.groupBy("tic").agg(F.count("_r").alias("n_expected"), F.count_if(F.col("_l").isNull()).alias("n_missing"), F.count_if(F.col("_r").isNull()).alias("n_unexpected"),
                             F.count_if(F.col("k") > 1).alias("n_duplicate"), F.count_if(both & (F.col("quality") != F.col("_q"))).alias("n_quality_mismatch"),
                             F.count_if(both & (F.col("orbitid") != F.col("_o"))).alias("n_orbit_mismatch"))
    return g.withColumn("missing_fraction", F.col("n_missing") / F.nullif("n_expected", F.lit(0)))


def _gate(name: str, row: DataFrame, checks: dict[str, Column], values: Sequence[str] = ()) -> DataFrame:
    """A one-row gate: worst of the checks, with the failing check names."""
    d = row.withColumns({f"_s_{k}": c for k, c in checks.items()})
    reasons = F.concat_ws(";", *[F.when(F.col(f"_s_{k}") != "pass", F.concat(F.lit(f"{k}:"), F.col(f"_s_{k}"))) for k in checks])
    return d.select(F.lit(name).alias("gate"), E.worst_status(*[F.col(f"_s_{k}") for k in checks]).alias("status"), reasons.alias("reasons"), *values)


def scatter_gate(metrics: DataFrame, targets: DataFrame, min_targets: int = 512) -> DataFrame:
    """log10 MAD against magnitude: clipped line per aperture, slope interval, share of high residuals, finite share."""
    j = metrics.join(targets.select("tic", "tmag"), "tic").withColumn("_y", F.when(F.col("mad_ppm") > 0, F.log10(F.when(F.col("mad_ppm") > 0, F.col("mad_ppm")))))
    fit = robust.clipped_line_fit(j, ["aperture"], F.col("tmag"), F.col("_y"))
    r = j.join(fit, "aperture").withColumn("_r", F.col("_y") - F.col("slope") * F.col("tmag") - F.col("intercept"))
    g = r.groupBy("aperture").agg(F.count(F.lit(1)).alias("n"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
                                  (F.count("_y") / F.count(F.lit(1))).alias("finite_fraction"), (F.count_if(F.col("_r") > HIGH_RESIDUAL_DEX) / F.count("_r")).alias("outlier_fraction"))
    checks = {"finite": E.status_min("finite_fraction", *SCATTER_FINITE), "slope": E.status_interval("slope", *SCATTER_SLOPE),
              "outliers": E.status_max("outlier_fraction", *SCATTER_OUTLIERS), "support": F.when(F.col("n") >= min_targets, "pass").otherwise("fail")}
    return _gate("scatter", g, checks, ["aperture", "n", "slope", "finite_fraction", "outlier_fraction"])


def cadence_gate(anomalies: DataFrame, metrics: DataFrame, apertures: int = 2) -> DataFrame:
    a = anomalies.agg(F.percentile("missing_fraction", 0.5).alias("loss_median"), F.percentile("missing_fraction", 0.95).alias("loss_p95"), F.count(F.lit(1)).alias("n_targets"),
                      F.sum(F.col("n_unexpected") + F.col("n_duplicate") + F.col("n_quality_mismatch") + F.col("n_orbit_mismatch")).alias("n_anomalies"))
    use = F.col("quality0_fraction") * F.col("finite_q0_fraction")
    m = metrics.agg(F.percentile("finite_q0_fraction", 0.5).alias("finite_median"), F.percentile("finite_q0_fraction", 0.05).alias("finite_p05"), F.percentile(use, 0.5).alias("usable_median"),
                    F.percentile(use, 0.05).alias("usable_p05"), F.count(F.lit(1)).alias("n_curves"))
    j = a.transform(with_row, m)
    checks = {"loss_median": E.status_max("loss_median", *LOSS_MEDIAN), "loss_p95": E.status_max("loss_p95", *LOSS_P95), "finite_median": E.status_min("finite_median", *FINITE_MEDIAN),
              "finite_p05": E.status_min("finite_p05", *FINITE_P05), "usable_median": E.status_min("usable_median", *USABLE_MEDIAN), "usable_p05": E.status_min("usable_p05", *USABLE_P05),
              "integrity": F.when((F.col("n_anomalies") == 0) & (F.col("n_curves") == F.col("n_targets") * apertures), "pass").otherwise("fail")}
    return _gate("cadence", j, checks, ["loss_median", "finite_median", "usable_median", "n_anomalies"])


def aperture_gate(pairs: DataFrame) -> DataFrame:
    r, c = F.col("mad_ratio"), F.col("correlation")
    bad = lambda lim: F.count_if((r < lim[0]) | (r > lim[1])) / F.nullif(F.count("mad_ratio"), F.lit(0))
    g = pairs.agg((F.count("mad_ratio") / F.count(F.lit(1))).alias("valid_fraction"), bad(RATIO_MODERATE).alias("moderate_fraction"), bad(RATIO_EXTREME).alias("extreme_fraction"),
                  (F.count_if(robust.finite(c)) / F.count(F.lit(1))).alias("correlation_valid"), F.percentile(robust.finite_or_null(c), 0.5).alias("correlation_median"),
                  (F.count_if(c < NEGATIVE_CORRELATION) / F.nullif(F.count("correlation"), F.lit(0))).alias("negative_fraction"))
    checks = {"valid": E.status_min("valid_fraction", *VALID_FRACTION), "moderate": E.status_max("moderate_fraction", *MODERATE_OUTLIERS), "extreme": E.status_max("extreme_fraction", *EXTREME_OUTLIERS),
              "correlation_valid": E.status_min("correlation_valid", *CORRELATION_VALID), "correlation": E.status_min("correlation_median", *CORRELATION_MEDIAN),
              "negative": E.status_max("negative_fraction", *NEGATIVE_FRACTION)}
    return _gate("aperture_pair", g, checks, ["moderate_fraction", "extreme_fraction", "correlation_median", "negative_fraction"])


def target_flags(targets: DataFrame, anomalies: DataFrame, metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Worst status per target with distinct reasons; a target without evidence in any table fails."""
    a = anomalies.select("tic", E.status_max("missing_fraction", *LOSS_P95).alias("cadence_status"))
    m = metrics.withColumn("_s", E.status_min("finite_q0_fraction", *FINITE_P05)).groupBy("tic").agg(
        F.max(F.when(F.col("_s") == "pass", 0).when(F.col("_s") == "review", 1).otherwise(2)).alias("_c")).select(
        "tic", F.when(F.col("_c") == 0, "pass").when(F.col("_c") == 1, "review").otherwise("fail").alias("aperture_status"))
    r = F.col("mad_ratio")
    ps = F.when(r.isNull(), "fail").when((r < RATIO_EXTREME[0]) | (r > RATIO_EXTREME[1]), "fail").when((r < RATIO_MODERATE[0]) | (r > RATIO_MODERATE[1]), "review").otherwise("pass")
    j = targets.select("tic").join(a, "tic", "left").join(m, "tic", "left").join(pairs.select("tic", ps.alias("pair_status")), "tic", "left")
    names = ("cadence_status", "aperture_status", "pair_status")
    fill = {n: F.coalesce(n, F.lit("fail")) for n in names}
    reasons = F.array_distinct(F.filter(F.array(*[F.when(F.col(n) != "pass", F.concat(F.lit(n[:-7] + ":"), F.col(n))) for n in names]), lambda x: x.isNotNull()))
    return j.withColumns(fill).withColumns({"status": E.worst_status(*names), "reasons": F.array_join(reasons, ";")})


def retention_gate(metrics: DataFrame, n_expected: int, faint_from: float = 19.0, min_faint: int = 32) -> DataFrame:
    """Injected-signal retention: exact row set, faint support and retention limits per aperture."""
    ok = F.col("status") == "ok"
    g = metrics.groupBy("aperture").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("injection_id").alias("n_ids"), F.count_if(ok).alias("n_ok"),
                                        F.count_if(ok & (F.col("tmag") >= faint_from)).alias("n_faint"), F.percentile("retention", 0.5).alias("retention_median"),
                                        F.percentile("retention", 0.1).alias("retention_p10"), (F.count_if(F.col("retention").between(0.5, 1.5)) / F.count(F.lit(1))).alias("inband_fraction"),
                                        support_ratio(F.col("period_d")).alias("period_ratio"))
    exact = (F.col("n_rows") == n_expected) & (F.col("n_ids") == n_expected) & (F.col("n_ok") == n_expected)
    checks = {"rows": F.when(exact, "pass").otherwise("fail"), "faint": F.when(F.col("n_faint") >= min_faint, "pass").otherwise("fail"), "median": E.status_interval("retention_median", *RETENTION),
              "p10": E.status_min("retention_p10", *RETENTION_P10), "inband": E.status_min("inband_fraction", *INBAND)}
    return _gate("retention", g, checks, ["aperture", "n_rows", "retention_median", "retention_p10", "inband_fraction"])


def support_ratio(c: Column) -> Column:
    """Largest over smallest positive finite value."""
    pos = F.when(robust.finite(c) & (c > 0), c)
    return F.max(pos) / F.nullif(F.min(pos), F.lit(0.0))


def compose(gates: Sequence[DataFrame]) -> DataFrame:
    """Worst status over all gate rows; no rows is a fail."""
    u = reduce(lambda a, b: a.unionByName(b), [g.select("gate", "status") for g in gates])
    g = u.agg(F.count(F.lit(1)).alias("n_gates"), F.count_if(F.col("status") == "fail").alias("n_fail"), F.count_if(F.col("status") == "review").alias("n_review"))
    status = F.when((F.col("n_gates") == 0) | (F.col("n_fail") > 0), "fail").when(F.col("n_review") > 0, "review").otherwise("pass")
    return g.withColumn("status", status)


def coverage_audit(peaks: DataFrame, targets: DataFrame, apertures: Sequence[str]) -> DataFrame:
    """Expected (target, aperture) pairs against searched ones; failed pairs and configuration uniqueness."""
    want = targets.select("tic", F.explode(F.array(*[F.lit(a) for a in apertures])).alias("aperture")).distinct().withColumn("_e", F.lit(True))
    got = peaks.groupBy("tic", "aperture").agg(F.count_if(F.col("status") == "ok").alias("n_ok")).withColumn("_g", F.lit(True))
    j = want.join(got, ["tic", "aperture"], "full_outer")
    s = j.agg(F.count("_e").alias("n_expected"), F.count_if(F.col("_g").isNull()).alias("n_missing"), F.count_if(F.col("_e").isNull()).alias("n_unexpected"), F.count_if(F.col("n_ok") == 0).alias("n_failed"))
    c = peaks.agg(F.countDistinct("bls_run_id").alias("n_run_ids"))
    return s.transform(with_row, c).withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_unexpected") == 0) & (F.col("n_run_ids") == 1))


def integrity_gate(metrics: DataFrame, pairs: DataFrame, min_targets: int) -> DataFrame:
    """First-level gates: enough targets, finite shares, pair correlation and scatter ratio."""
    m = metrics.agg(F.countDistinct("tic").alias("n"), F.percentile("finite_q0_fraction", 0.5).alias("fm"), F.percentile("finite_q0_fraction", 0.05).alias("f5"), F.percentile("quality0_fraction", 0.5).alias("qm"))
    p = pairs.agg((F.count_if(robust.finite(F.col("correlation"))) / F.count(F.lit(1))).alias("cv"), F.percentile(robust.finite_or_null(F.col("correlation")), 0.5).alias("cm"), F.percentile("mad_ratio", 0.5).alias("rm"))
    b = lambda c: F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail")
    checks = {"photometry": b((F.col("n") >= min_targets) & (F.col("fm") >= 0.95) & (F.col("f5") >= 0.50) & (F.col("qm") >= 0.50)),
              "apertures": b((F.col("cv") >= 0.90) & (F.col("cm") >= 0.30) & F.col("rm").between(0.10, 10.0))}
    return _gate("integrity", m.transform(with_row, p), checks, ["n", "fm", "cm", "rm"])


def magnitude_bins(metrics: DataFrame, value: str, bins: int = 5, by: str = "tmag") -> DataFrame:
    """Medians in quantile bins of magnitude; equal edges collapse. Edges are one small row, broadcast."""
    edges = metrics.agg(F.array_distinct(F.percentile(by, [i / bins for i in range(bins + 1)])).alias("e"))
    j = metrics.transform(with_row, edges)
    b = F.greatest(F.lit(0), F.size(F.filter("e", lambda x: x < F.col(by))) - 1)
    return j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi"), F.percentile(value, 0.5).alias("median_value"))


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-independent hash of distinct rows: hashes are bucketed by prefix, each bucket's sorted list is hashed,
    then the bucket hashes. Buckets bound what any task collects."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    h = df.select(row.alias("h")).distinct().withColumn("b", F.substring("h", 1, 4))
    per = h.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("bh"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "bh"))), lambda s: s["bh"]), ""), 256).alias("content_sha256"))


def rule_table(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one aggregate."""
    s = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r_{k}") for k, c in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r_{k}").alias("n_bad")) for k in rules])).alias("x")
    return s.select("_n", rows).select("x.rule", F.col("_n").alias("n_rows"), "x.n_bad", ((F.col("x.n_bad") == 0) & (F.col("_n") > 0)).alias("passed"))


def peak_table_rules(df: DataFrame) -> DataFrame:
    return rule_table(df, {"rank_positive": F.col("peak_rank") > 0, "period_positive": F.col("period_d") > 0, "finite_depth": robust.finite(F.col("depth")), "duration_below_period": F.col("duration_min") < F.col("period_d") * K.MIN_PER_DAY,
                           "known_aperture": F.col("aperture").isin("SML", "PRI"), "status_ok": F.col("status") == "ok"})


def readiness(df: DataFrame, requirements: dict[str, tuple[str, dict[str, int]]]) -> DataFrame:
    """(gate, dimension, value, required, current, deficit, passed) from one unpivoted count."""
    dims = sorted({d for d, _ in requirements.values()})
    long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")).select("x.*")
    have = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("current"))
    rows = [(g, d, v, n) for g, (d, vs) in requirements.items() for v, n in vs.items()]
    need = df.sparkSession.createDataFrame(rows, "gate string, dimension string, value string, required bigint")
    j = F.broadcast(need).join(have, ["dimension", "value"], "right").where("gate IS NOT NULL").unionByName(
        need.join(have, ["dimension", "value"], "left_anti").withColumn("current", F.lit(0).cast("bigint")).select("dimension", "value", "gate", "required", "current"))
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("required") - F.col("current"))
    return j.select("gate", "dimension", "value", "required", "current", gap.alias("deficit"), (gap == 0).alias("passed"))


def release_gate(members: DataFrame, min_members: int = 3, min_recall: float = 0.40, min_ap: float = 0.10) -> DataFrame:
    """Pooled held-out recall and positive-weighted average precision over ensemble members."""
    g = members.agg(F.count(F.lit(1)).alias("n_members"), (F.sum("n_recovered") / F.nullif(F.sum("n_positive"), F.lit(0))).alias("pooled_recall"),
                    (F.sum(F.col("average_precision") * F.col("n_positive")) / F.nullif(F.sum("n_positive"), F.lit(0))).alias("weighted_ap"))
    ok = (F.col("n_members") >= min_members) & (F.col("pooled_recall") >= min_recall) & (F.col("weighted_ap") >= min_ap)
    return g.withColumn("passed", F.coalesce(ok, F.lit(False)))
