"""Quota buckets over one table: exact cuts, one ranked pass for all buckets, overflow fills and selection weights.

Buckets are filled in order and a row taken by one is out for the next. Of ``n`` rows in all, a bucket can lose at most those
taken before it, so its first ``n`` rows decide it: one pass ranks every row in each bucket it fits and keeps that many, and only this
bounded preference table (at most buckets x ``n`` rows, however large the input) is walked bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions.hashing import digest
from lumensift.operators import robust, select as S, skew
from lumensift.operators.ordering import cut_lineage
from lumensift.operators.vet import first_by

#: Hashed parts of a bucket that are ranked apart before the bucket as a whole.
PARTS = 64


@dataclass(frozen=True)
class Quota:
    """At most ``n`` rows (None: all that is still wanted) where ``where`` holds, in the table's order if ``ranked``, else in hash order."""

    name: str
    n: int | None
    where: Column
    ranked: bool = False


def select_quotas(df: DataFrame, quotas: Sequence[Quota], n: int, seed: int, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """``n`` rows with ``selection_bucket`` and ``selection_weight`` = rows that fit the bucket / rows it took.

    ``order`` ranks the rows of ranked buckets: ascending, missing values last (negate for descending); ties and unranked buckets go by a
    hash of ``key``, which must be unique. Fewer than ``n`` rows in all buckets together are an error.
    """
    fits = {f"_m{i}": F.coalesce(q.where, F.lit(False)) for i, q in enumerate(quotas)}
    marked = df.withColumns(fits)
    place = F.struct(*[c for i, o in enumerate(order) for c in (o.isNull().alias(f"n{i}"), F.coalesce(o.cast("double"), F.lit(0.0)).alias(f"v{i}"))]) if order else F.struct(F.lit(0).alias("n0"))
    entry = lambda i, q: F.when(F.col(f"_m{i}"), F.struct(F.lit(i).alias("b"), (place if q.ranked else F.when(F.lit(False), place)).alias("s"), digest(F.col(key), seed + i).alias("h")))
    c = marked.select(F.col(key), F.explode(F.array_compact(F.array(*[entry(i, q) for i, q in enumerate(quotas)]))).alias("e")).select(key, "e.*")
    c = c.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    for part in (["b", "_part"], ["b"]):
        c = c.withColumn("_rank", F.row_number().over(W.partitionBy(*part).orderBy("s", "h", key))).where(F.col("_rank") <= n)
    p = c.groupBy(key).agg(*[F.max(F.when(F.col("b") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(quotas))])
    p = p.withColumns({"_one": F.lit(1), "_taken": F.lit(-1)})
    every = W.partitionBy("_one")  # the bounded preference table
    for i, q in enumerate(quotas):
        mine = F.when(F.col("_taken") < 0, F.col(f"_r{i}"))
        p = p.withColumns({"_at": F.row_number().over(every.orderBy(mine.asc_nulls_last(), key)), "_used": F.count_if(F.col("_taken") >= 0).over(every)})
        room = F.least(F.lit(n if q.n is None else q.n).cast("bigint"), n - F.col("_used"))
        p = p.withColumn("_taken", F.when(mine.isNotNull() & (F.col("_at") <= room), F.lit(i)).otherwise(F.col("_taken")))
    names = F.array(*[F.lit(q.name) for q in quotas])
    got = cut_lineage(p.where("_taken >= 0").select(key, "_taken", F.element_at(names, F.col("_taken") + 1).alias("selection_bucket"), F.count(F.lit(1)).over(W.partitionBy("_taken")).alias("_k")))
    if got.count() != n:
        raise ValueError(f"buckets hold {got.count()} rows, {n} are wanted")
    available = marked.agg(F.array(*[F.count_if(f"_m{i}") for i in range(len(quotas))]).alias("_av"))
    out = df.join(got, key).transform(skew.with_row, available)
    return out.withColumn("selection_weight", F.element_at("_av", F.col("_taken") + 1) / F.col("_k")).drop("_taken", "_k", "_av")


def attach_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact table-wide quantiles ``{out: (column, p)}`` beside every row; large tables narrow histograms instead of gathering values."""
    hot = skew.has_hot_group(df, [])
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        df = df.transform(skew.with_row, robust.grouped_quantiles(df, [], F.col(column), {o: p for o, (c, p) in wanted.items() if c == column}, hot))
    return df


# Bucket names and their rows.
REAL_QUOTAS = {
    "real_benchmark": 1, "real_high_sde_planet_like": 1800, "real_eb_pceb_like": 2200, "real_variability_broad_duration": 1100,
    "real_aperture_disagreement": 1000, "real_cadence_alias_systematic": 700, "real_mid_sde_control": 1400, "real_low_sde_control": 800,
}
INJECTED_QUOTAS = {"inj_bls_top1_recovered": 300, "inj_topn_or_harmonic": 200, "inj_peak_mismatch_mid_snr": 300, "inj_low_snr_or_expected_missed": 200}
REVIEW_QUOTAS = {
    "real_benchmark": 1, "real_high_sde_planet_like": 260, "real_eb_pceb_like": 160, "real_variability_broad_duration": 95,
    "real_aperture_disagreement": 70, "real_cadence_alias_systematic": 45, "real_mid_sde_control": 45, "real_low_sde_control": 24,
}


def real_pool(df: DataFrame, n: int, seed: int, benchmark: int, quotas: dict[str, int] | None = None) -> DataFrame:
    """Review pool of real candidates: one row per target (the smallest review_id), eight buckets with cuts from the table, two fills.

    Columns: review_id, tic, period_d, t0_bjd, duration_min, sde_max, n_apertures_agree, period_cluster_count, vet_class, class_rank,
    is_alias. Rows without an ephemeris are left out. ``quotas`` replaces the published sizes.
    """
    q = {**REAL_QUOTAS, **(quotas or {})}
    d = first_by(df.where("tic IS NOT NULL AND period_d IS NOT NULL AND t0_bjd IS NOT NULL AND duration_min IS NOT NULL"), ["tic"], F.col("review_id"))
    d = attach_quantiles(d, {"_q40": ("sde_max", 0.4), "_q70": ("sde_max", 0.7), "_d80": ("duration_min", 0.8), "_c95": ("period_cluster_count", 0.95)})
    sde = F.col("sde_max")
    alias = F.coalesce(F.col("is_alias"), F.lit(False)) | F.coalesce(F.col("period_cluster_count") >= F.col("_c95"), F.lit(False))
    broad = (F.col("duration_min") >= F.greatest(F.lit(15.0), F.coalesce("_d80", F.lit(30.0)))) | (F.col("period_d") >= 3.0)
    rule = {
        "real_benchmark": (F.col("tic") == benchmark, True), "real_high_sde_planet_like": ((F.col("vet_class") == "planet_candidate") & ~alias, True),
        "real_eb_pceb_like": (F.col("vet_class").isin("pceb_grid_ceiling", "sub_roche_pceb_suspect") & ~alias, True),
        "real_variability_broad_duration": (broad & ~alias, False), "real_aperture_disagreement": ((F.col("n_apertures_agree") <= 1) & ~alias, False),
        "real_cadence_alias_systematic": (alias, True), "real_mid_sde_control": ((sde >= F.col("_q40")) & (sde < F.col("_q70")) & ~alias, False),
        "real_low_sde_control": ((sde < F.col("_q40")) & ~alias, False),
    }
    buckets = [Quota(k, q[k], where, ranked) for k, (where, ranked) in rule.items()]
    buckets += [Quota("real_stratified_fill", None, ~alias), Quota("real_alias_overflow_fill", None, F.lit(True))]
    return select_quotas(d, buckets, n, seed, "review_id", [F.col("class_rank"), -sde]).drop("_q40", "_q70", "_d80", "_c95")


def recovery_mode(df: DataFrame) -> DataFrame:
    """``mode`` of each injection: recovered first, among the top peaks or a harmonic, missed at low signal, or another peak."""
    d = attach_quantiles(df, {"_s35": ("depth_snr", 0.35), "_e35": ("sde_max", 0.35), "_r25": ("radius_rearth", 0.25)})
    topn, rec = F.coalesce("topn_recovery_status", F.lit("")), F.coalesce("recovery_status", F.lit(""))
    low = F.lit(False)
    for v, cut in (("depth_snr", "_s35"), ("sde_max", "_e35"), ("radius_rearth", "_r25")):
        low = low | F.coalesce(F.col(v) <= F.col(cut), F.lit(False))
    mode = (F.when(topn.isin("bls_topn_recovered", "bls_topn_harmonic_match"), "inj_topn_or_harmonic").when((topn == "bls_top1_recovered") | (rec == "bls_recovered"), "inj_bls_top1_recovered")
            .when(low, "inj_low_snr_or_expected_missed").otherwise("inj_peak_mismatch_mid_snr"))
    return d.withColumn("mode", mode).drop("_s35", "_e35", "_r25")


def balanced_buckets(df: DataFrame, bucket: str, quotas: dict[str, int], cells: Sequence[str], seed: int, key: str) -> DataFrame:
    """Each bucket's quota, spread over its cells: an equal share of each cell first, then the rest in hash order. One pass for all buckets."""
    d = df.where(F.col(bucket).isin(*quotas)).withColumn("_n", F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(bucket)))
    share = d.select(bucket, "_n", *cells).distinct().groupBy(bucket).agg(F.ceil(F.first("_n") / F.count(F.lit(1))).alias("_share"))
    d = d.join(share, bucket).withColumn("_h", digest(F.col(key), seed))
    most = max(quotas.values())
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(bucket, *cells).orderBy("_h", key))).where(F.col("_r") <= most)
    over = (F.col("_r") > F.col("_share")).cast("int")
    d = d.withColumn("_t", F.row_number().over(W.partitionBy(bucket).orderBy(over, F.when(over == 0, F.col("_r")).otherwise(0), "_h", key)))
    return d.where((F.col("_t") <= most) & (F.col("_t") <= F.col("_n"))).drop("_n", "_share", "_h", "_r", "_t")


def injected_pool(df: DataFrame, n: int, seed: int, period_range: tuple[float, float], quotas: dict[str, int] | None = None,
                  cells: Sequence[str] = ("grid_period_bin", "grid_radius_bin")) -> DataFrame:
    """Injections for review: usable ones by recovery mode, each mode balanced over grid cells, then a balanced fill.

    Columns: injection_id (unique), truth_period_d, radius_rearth, n_good_in_transit, depth_snr, sde_max,
    recovery_status, topn_recovery_status, and ``cells``. ``selection_weight`` = rows that fit the bucket / rows it took.
    """
    q = {**INJECTED_QUOTAS, **(quotas or {})}
    usable = F.col("truth_period_d").between(*period_range) & F.col("radius_rearth").isNotNull() & (F.coalesce("n_good_in_transit", F.lit(0)) >= 2) & F.col("injection_id").isNotNull()
    d = cut_lineage(recovery_mode(df.where(usable)))
    first = cut_lineage(balanced_buckets(d, "mode", q, cells, seed, "injection_id").select("injection_id", F.col("mode").alias("selection_bucket")))
    k = first.count()
    if k > n:
        raise ValueError(f"quotas ask for {k} rows, {n} are wanted")
    fill = S.balanced_cells(d.join(first, "injection_id", "left_anti"), cells, n - k, seed + 100, "injection_id").select("injection_id", F.lit("inj_balanced_fill").alias("selection_bucket"))
    got = cut_lineage(first.unionByName(fill))
    if got.count() != n:
        raise ValueError(f"buckets hold {got.count()} rows, {n} are wanted")
    fits = d.groupBy(F.col("mode").alias("selection_bucket")).agg(F.count(F.lit(1)).alias("_av"))
    fits = fits.unionByName(d.agg(F.count(F.lit(1)).alias("_av")).select(F.lit("inj_balanced_fill").alias("selection_bucket"), "_av"))
    took = got.groupBy("selection_bucket").agg(F.count(F.lit(1)).alias("_k"))
    w = fits.join(took, "selection_bucket").select("selection_bucket", (F.col("_av") / F.col("_k")).alias("selection_weight"))
    return d.join(got, "injection_id").join(w, "selection_bucket")


def edge_bin(value: str, edges: Sequence[float]) -> Column:
    """0-based bin between ascending edges, each closed above and the first closed below; NULL outside."""
    v = F.col(value)
    bins = F.when(v == edges[0], 0)
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        bins = bins.when((v > lo) & (v <= hi), i)
    return bins


def boundary_cells(df: DataFrame, edges: dict[str, Sequence[float]]) -> DataFrame:
    """Rows beside their cell (one bin per axis) and its share of injections found exactly, among the top peaks or at a harmonic."""
    d = df.withColumns({f"{c}_cell": edge_bin(c, e) for c, e in edges.items()})
    cells = [f"{c}_cell" for c in edges]
    strict = F.coalesce(F.col("recovery_status") == "bls_recovered", F.lit(False))
    d = d.withColumns({"strict": strict, "found": strict | F.coalesce(F.col("topn_recovery_status").isin("bls_top1_recovered", "bls_topn_recovered", "bls_topn_harmonic_match"), F.lit(False))})
    inside = d.where(" AND ".join(f"{c} IS NOT NULL" for c in cells))
    g = inside.groupBy(*cells).agg(F.count(F.lit(1)).alias("cell_n"), F.avg(F.col("strict").cast("double")).alias("cell_strict_frac"), F.avg(F.col("found").cast("double")).alias("cell_any_frac"))
    return d.join(g.withColumn("cell_distance", F.abs(F.col("cell_any_frac") - 0.5)), cells, "left")


def boundary_sample(df: DataFrame, edges: dict[str, Sequence[float]], n: int, seed: int, limits: tuple[float, float], min_good: int = 2, excluded: DataFrame | None = None) -> DataFrame:
    """Exactly recovered injections of cells near half recovery, balanced over the cells; weight = rows of the cell that qualify / taken."""
    d = boundary_cells(df, edges).where(F.col("strict") & F.col("cell_any_frac").between(*limits) & (F.coalesce("n_good_in_transit", F.lit(0)) >= min_good))
    d = cut_lineage(S.exclude(d, excluded, "injection_id"))
    cells = [f"{c}_cell" for c in edges]
    got = cut_lineage(S.balanced_cells(d, cells, n, seed, "injection_id"))
    if got.count() != n:
        raise ValueError(f"only {got.count()} injections near the boundary, {n} are wanted")
    fits = d.groupBy(*cells).agg(F.count(F.lit(1)).alias("_av"))
    took = got.groupBy(*cells).agg(F.count(F.lit(1)).alias("_k"))
    return got.join(fits.join(took, cells), cells).withColumn("selection_weight", F.col("_av") / F.col("_k")).drop("_av", "_k")


def scaled_quotas(quotas: dict[str, int], n: int, single: str, rest: str) -> dict[str, int]:
    """Quotas scaled to ``n`` rows, at least one each (``single`` exactly one); ``rest`` takes what rounding leaves."""
    total = sum(quotas.values())
    if total <= 0 or n <= 0:
        raise ValueError("quotas must ask for at least one row")
    out = {k: (min(1, n) if k == single else max(1, round(v * (n / total)))) for k, v in quotas.items()} if n != total else dict(quotas)
    out[rest] += n - sum(out.values())
    return out


def downsample(pool: DataFrame, n: int, seed: int, quotas: dict[str, int] | None = None, ranked: Sequence[str] = ("real_benchmark", "real_high_sde_planet_like", "real_eb_pceb_like", "real_cadence_alias_systematic")) -> DataFrame:
    """A smaller review mix from a pool's buckets: scaled quotas, strongest first in ``ranked`` buckets, then a fill from any bucket."""
    q = scaled_quotas(quotas or REVIEW_QUOTAS, n, "real_benchmark", "real_high_sde_planet_like")
    d = pool.withColumnsRenamed({"selection_bucket": "pool_bucket", "selection_weight": "pool_weight"})
    buckets = [Quota(k, v, F.col("pool_bucket") == k, k in ranked) for k, v in q.items()] + [Quota("real_fill", None, F.lit(True))]
    return select_quotas(d, buckets, n, seed, "review_id", [F.col("class_rank"), -F.col("sde_max")])
