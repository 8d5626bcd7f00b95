"""Recovery of injections among each aperture's top peaks, and searches that only compute what changed."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import cadence, search
from lumensift.operators.ordering import cut_lineage

CURVE = cadence.CURVE


def matched_peaks(peaks: DataFrame, truth: DataFrame, tol: float = K.PERIOD_TOL) -> DataFrame:
    """The usable peaks beside their injection: period_rel_err, t0_phase_err_min, nearest harmonic, and whether they are exact or harmonic."""
    t = truth.select("injection_id", "truth_period_d", "truth_t0_bjd", "truth_duration_min")
    d = peaks.where((F.col("status") == "ok") & (F.col("peak_rank") > 0)).join(t, "injection_id")
    limit = F.greatest(F.coalesce(F.nanvl("truth_duration_min", F.lit(20.0)), F.lit(20.0)), F.lit(20.0))
    ratio = F.col("period_d") / F.col("truth_period_d")
    d = d.withColumns({"period_ratio": ratio, "_h": E.nearest_harmonic(ratio), "period_rel_err": F.abs(F.col("period_d") - F.col("truth_period_d")) / F.col("truth_period_d"),
                       "t0_phase_err_min": E.phase_minutes("t0_bjd", "truth_period_d", "truth_t0_bjd"),
                       "harmonic_t0_err_min": E.phase_minutes("t0_bjd", F.least("period_d", "truth_period_d"), "truth_t0_bjd")})
    near = (F.col("_h.rel_err") <= tol) & (F.abs("harmonic_t0_err_min") <= limit)
    return d.withColumns({"harmonic_factor": F.col("_h.factor"), "harmonic_rel_err": F.col("_h.rel_err"), "harmonic_ephemeris": F.coalesce(near, F.lit(False)),
                          "exact": F.coalesce((F.col("period_rel_err") <= tol) & (F.abs("t0_phase_err_min") <= limit), F.lit(False)),
                          "harmonic": F.coalesce(near & (F.abs(F.col("_h.factor") - 1) >= 1e-8), F.lit(False))}).drop("_h")


def aperture_recovery(peaks: DataFrame, truth: DataFrame, tol: float = K.PERIOD_TOL) -> DataFrame:
    """Per injection and aperture: the strongest peak and whether it is exact, the first exact and the first harmonic peak by rank. One aggregate.
    Strongest: greater sde, then smaller rank, period, epoch, duration, depth and depth_snr; first: smaller rank, then sde and harmonic factor."""
    d = matched_peaks(peaks, truth, tol)
    row = F.struct("sde", "peak_rank", "period_d", "t0_bjd", "duration_min", "depth", "depth_snr", "period_rel_err", "t0_phase_err_min", "exact")
    hit = F.struct("peak_rank", "sde", "period_rel_err", "t0_phase_err_min")
    harm = F.struct("peak_rank", "sde", "harmonic_factor", "harmonic_rel_err", "harmonic_t0_err_min")
    g = d.groupBy("injection_id", "aperture").agg(
        F.max_by(row, F.struct(F.nanvl("sde", F.lit(float("-inf"))), *[-F.col(c) for c in ("peak_rank", "period_d", "t0_bjd", "duration_min", "depth", "depth_snr")])).alias("best"), F.min_by(F.struct("period_ratio", "harmonic_factor", "harmonic_ephemeris"), "peak_rank").alias("top"),
        F.min(F.when(F.col("exact"), hit)).alias("exact_peak"), F.min(F.when(F.col("harmonic"), harm)).alias("harmonic_peak"), F.count(F.lit(1)).alias("n_peaks"))
    return g.withColumns({"recovered": F.col("best.exact"), "topn_recovered": F.col("exact_peak").isNotNull(), "harmonic_matched": F.col("harmonic_peak").isNotNull()})


def injection_recovery(peaks: DataFrame, truth: DataFrame, apertures: Sequence[str], tol: float = K.PERIOD_TOL) -> DataFrame:
    """One row per injection of ``truth``: the chosen peak, the apertures that agree (by strongest, any top, any harmonic peak), recovery statuses.

    The chosen peak is the strongest among the apertures whose strongest peak is exact, else the strongest of all. An injection without a
    usable peak has status bls_<status of its rows>, or bls_missing without any row.
    """
    g = aperture_recovery(peaks, truth, tol).where(F.col("aperture").isin(*apertures))
    choice = F.struct(F.col("recovered"), F.nanvl("best.sde", F.lit(float("-inf"))), -F.array_position(F.array(*[F.lit(a) for a in apertures]), F.col("aperture")))
    names = lambda flag: F.array_join(F.filter(F.array(*[F.max(F.when((F.col("aperture") == a) & F.col(flag), F.lit(a))) for a in apertures]), lambda x: x.isNotNull()), ",")
    per = []
    for a in apertures:
        here = F.col("aperture") == a
        per += [F.max(F.when(here, F.col("best.sde"))).alias(f"sde_{a}"), F.max(F.when(here, F.col("best.peak_rank"))).alias(f"rank_{a}"), F.max(F.when(here, F.col("exact_peak.peak_rank"))).alias(f"topn_rank_{a}"),
                F.max(F.when(here, F.col("harmonic_peak.peak_rank"))).alias(f"harmonic_rank_{a}"), F.max(F.when(here, F.col("harmonic_peak.harmonic_factor"))).alias(f"harmonic_factor_{a}")]
    m = g.groupBy("injection_id").agg(F.max_by(F.struct("aperture", "best.*"), choice).alias("c"), names("recovered").alias("apertures_agree"), names("topn_recovered").alias("topn_apertures_agree"),
                                      names("harmonic_matched").alias("harmonic_apertures_agree"), *[F.count_if(f).alias(n) for f, n in (("recovered", "n_apertures_agree"), ("topn_recovered", "n_topn_apertures_agree"), ("harmonic_matched", "n_harmonic_apertures_agree"))], *per)
    failed = peaks.where(F.col("aperture").isin(*apertures)).groupBy("injection_id").agg(F.min(F.when(F.col("status") != "ok", F.col("status"))).alias("_failed"))
    d = truth.select("injection_id", "tic", "truth_period_d", "truth_t0_bjd", "truth_duration_min").join(m, "injection_id", "left").join(failed, "injection_id", "left")
    lost = F.concat(F.lit("bls_"), F.coalesce("_failed", F.lit("missing")))
    status = F.when(F.col("c").isNull(), lost).when(F.col("n_apertures_agree") > 0, "bls_recovered").otherwise("bls_peak_mismatch")
    d = d.withColumn("recovery_status", status)
    topn = F.when(F.col("n_apertures_agree") > 0, "bls_top1_recovered").when(F.col("n_topn_apertures_agree") > 0, "bls_topn_recovered").when(F.col("n_harmonic_apertures_agree") > 0, "bls_topn_harmonic_match").otherwise(F.col("recovery_status"))
    some = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return d.select("injection_id", "tic", F.col("c.aperture").alias("rep_aperture"), *[F.col(f"c.{c}").alias(c) for c in ("period_d", "t0_bjd", "duration_min", "depth", "depth_snr", "sde", "peak_rank", "period_rel_err", "t0_phase_err_min")],
                    "recovery_status", topn.alias("topn_recovery_status"), *[some(f"n_{k}apertures_agree") for k in ("", "topn_", "harmonic_")], *[text(f"{k}apertures_agree") for k in ("", "topn_", "harmonic_")],
                    *[f"{k}_{a}" for a in apertures for k in ("sde", "rank", "topn_rank", "harmonic_rank", "harmonic_factor")])


# --- searches that only compute what changed ----------------------------------

def config_key(cfg: search.SearchConfig) -> str:
    return hashlib.sha256(json.dumps(asdict(cfg), sort_keys=True).encode()).hexdigest()


def curve_fingerprints(cadences: DataFrame, cfg: search.SearchConfig) -> DataFrame:
    """tic, aperture, fingerprint of the curve's rows and the settings. Row hashes are summed and combined by exclusive or, so tasks combine before
    the shuffle, order plays no part, and a changed, lost or repeated row changes the result."""
    h = F.xxhash64("cadenceno", "time", "orbitid", "quality", "flux")
    g = cadences.withColumn("_h", h).groupBy(*CURVE).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("x"), F.sum(F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), F.sum(F.shiftrightunsigned("_h", 32)).alias("hi"))
    return g.select(*CURVE, F.sha2(F.concat_ws("|", F.lit(config_key(cfg)), "n", "x", "lo", "hi"), 256).alias("fingerprint"))


def changed(now: DataFrame, done: DataFrame) -> DataFrame:
    """The curves of ``now`` whose fingerprint ``done`` doesn't have."""
    return now.join(done.select(*CURVE, "fingerprint").distinct(), [*CURVE, "fingerprint"], "left_anti")


def curve_shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64(*CURVE), F.lit(n_shards)).cast("int")


def _table(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def incremental_search(cadences: DataFrame, cfg: search.SearchConfig, path: str, n_shards: int = 16, hot: bool = False) -> int:
    """Search the curves that are new or changed since the runs recorded below ``path``; returns the number of shards that had work.

    Each shard's peaks are written to a folder of their own, then its stamp: curve, fingerprint and that folder's name. Peaks without a stamp, as
    a stopped run leaves them, are never read, and the next run starts at the first shard without one.
    """
    spark = cadences.sparkSession
    now = curve_fingerprints(cadences, cfg).withColumn("shard", curve_shard(n_shards))
    stamps = _table(spark, f"{path}/stamps")
    todo = now if stamps is None else changed(now, stamps)
    todo = cut_lineage(todo)  # the stamps change while shards are written
    shards = sorted(r.shard for r in todo.select("shard").distinct().collect())  # at most n_shards numbers
    for k in shards:
        mine, batch = todo.where(F.col("shard") == k), os.urandom(8).hex()
        rows = search.search(cadences.join(mine.select(*CURVE), CURVE, "left_semi"), cfg, hot)
        rows.join(mine.select(*CURVE, "fingerprint"), CURVE).write.parquet(f"{path}/peaks/batch={batch}")
        mine.select(*CURVE, "fingerprint", F.lit(k).alias("shard"), F.lit(batch).alias("batch")).write.mode("append").parquet(f"{path}/stamps")
    return len(shards)


def current_peaks(cadences: DataFrame, cfg: search.SearchConfig, path: str) -> DataFrame:
    """The stamped peaks of the curves as they are now; a curve that was searched twice alike counts once."""
    spark = cadences.sparkSession
    stamps = spark.read.parquet(f"{path}/stamps").groupBy(*CURVE, "fingerprint").agg(F.min("batch").alias("batch"))
    wanted = curve_fingerprints(cadences, cfg).join(stamps, [*CURVE, "fingerprint"])
    return spark.read.parquet(f"{path}/peaks").join(wanted, [*CURVE, "fingerprint", "batch"], "left_semi").drop("batch")
