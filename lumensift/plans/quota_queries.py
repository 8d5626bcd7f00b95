"""Queries of quota pools: real and injected candidates, boundary cells, downsampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.operators import quotas as Q
from lumensift.plans.registry import query, r
from lumensift.plans.selection_queries import dg
from lumensift.plans.views import INJECTIONS, SCORES
from lumensift.sources import binding as B

SMALL = {"real_high_sde_planet_like": 14, "real_eb_pceb_like": 12, "real_variability_broad_duration": 20, "real_aperture_disagreement": 9,
         "real_cadence_alias_systematic": 8, "real_mid_sde_control": 10, "real_low_sde_control": 7}
N_REAL = 120

POOL = """
cp AS (SELECT *, 2457000.5::DOUBLE AS t0_bjd, 1 + review_id % 2 AS agree, review_id % 40 AS cluster, CASE truth WHEN 0 THEN 'planet_candidate' WHEN 1 THEN 'pceb_grid_ceiling' ELSE 'other' END AS vet_class, CASE WHEN review_id % 6 > 0 THEN review_id % 6 END AS class_rank, review_id % 23 = 0 AS is_alias FROM scores),
c1 AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY tic ORDER BY review_id) = 1),
c2 AS (SELECT *, quantile_cont(sde_max, 0.4) OVER () AS q40, quantile_cont(sde_max, 0.7) OVER () AS q70, quantile_cont(duration_min, 0.8) OVER () AS d80, quantile_cont(cluster, 0.95) OVER () AS c95 FROM c1),
pool AS (SELECT *, is_alias OR cluster >= c95 AS al FROM c2)"""

REAL_RULES = [
    ("real_benchmark", "tic = 17", True), ("real_high_sde_planet_like", "vet_class = 'planet_candidate' AND NOT al", True), ("real_eb_pceb_like", "vet_class = 'pceb_grid_ceiling' AND NOT al", True),
    ("real_variability_broad_duration", "(duration_min >= greatest(15, d80) OR period_d >= 3) AND NOT al", False), ("real_aperture_disagreement", "agree <= 1 AND NOT al", False),
    ("real_cadence_alias_systematic", "al", True), ("real_mid_sde_control", "sde_max >= q40 AND sde_max < q70 AND NOT al", False), ("real_low_sde_control", "sde_max < q40 AND NOT al", False),
    ("real_stratified_fill", "NOT al", False), ("real_alias_overflow_fill", "true", False)]


def chain(table, rules, quotas, n, seed, tag):
    """CTEs that fill the buckets one after another."""
    parts = []
    for i, (name, where, ranked) in enumerate(rules):
        used = "".join(f" AND review_id NOT IN (SELECT review_id FROM {tag}{j})" for j in range(i))
        room = f"{n} - (0" + "".join(f" + (SELECT count(*) FROM {tag}{j})" for j in range(i)) + ")"
        size = f"least({quotas[name]}, {room})" if name in quotas else room
        order = ("class_rank IS NULL, class_rank, sde_max IS NULL, sde_max DESC, " if ranked else "") + dg(seed + i, "review_id")
        parts.append(f"{tag}{i} AS (SELECT *, '{name}' AS bk, (SELECT count(*) FROM {table} WHERE {where}) AS av FROM {table} WHERE {where}{used} QUALIFY row_number() OVER (ORDER BY {order}, review_id) <= {size})")
    return ", ".join(parts) + f", {tag} AS (" + " UNION ALL ".join(f"SELECT * FROM {tag}{i}" for i in range(len(rules))) + ")"


REAL = chain("pool", REAL_RULES, {"real_benchmark": 1, **SMALL}, N_REAL, 5, "rk")


def pool(spark, d):
    k = F.col("review_id")
    s = B.scores(spark, d).withColumns({
        "t0_bjd": F.lit(2457000.5), "n_apertures_agree": 1 + k % 2, "period_cluster_count": k % 40, "is_alias": k % 23 == 0, "class_rank": F.when(k % 6 > 0, k % 6),
        "vet_class": F.when(F.col("truth") == 0, "planet_candidate").when(F.col("truth") == 1, "pceb_grid_ceiling").otherwise("other")})
    return Q.real_pool(s, N_REAL, 5, 17, SMALL)


@query("real_quota_pool", SCORES, POOL, REAL, sql="SELECT review_id, tic, bk AS selection_bucket, round(av / count(*) OVER (PARTITION BY bk), 8) AS selection_weight FROM rk")
def real_quota_pool(spark, d):
    return pool(spark, d).select("review_id", "tic", "selection_bucket", r("selection_weight", 8).alias("selection_weight"))


N_DOWN = 40
SCALED = Q.scaled_quotas(Q.REVIEW_QUOTAS, N_DOWN, "real_benchmark", "real_high_sde_planet_like")
DOWN = chain("rp", [(k, f"pool_bucket = '{k}'", k in ("real_benchmark", "real_high_sde_planet_like", "real_eb_pceb_like", "real_cadence_alias_systematic")) for k in SCALED] + [("real_fill", "true", False)], SCALED, N_DOWN, 9, "dk")


@query("quota_downsample", SCORES, POOL, REAL, "rp AS (SELECT * EXCLUDE (bk, av), bk AS pool_bucket FROM rk)", DOWN, sql="""
SELECT review_id, pool_bucket, bk AS selection_bucket, round(av / count(*) OVER (PARTITION BY bk), 8) AS selection_weight FROM dk""")
def quota_downsample(spark, d):
    return Q.downsample(pool(spark, d), N_DOWN, 9).select("review_id", "pool_bucket", "selection_bucket", r("selection_weight", 8).alias("selection_weight"))


INJ = """
ij AS (SELECT *, (injection_id * 13 % 101) / 10 AS depth_snr, (injection_id * 31 % 97) / 4 AS sde_max, CASE WHEN injection_id % 4 = 0 THEN 'bls_recovered' ELSE 'bls_peak_mismatch' END AS rec,
  CASE WHEN injection_id % 4 = 0 THEN 'bls_top1_recovered' WHEN injection_id % 4 = 1 AND injection_id % 3 = 0 THEN 'bls_topn_harmonic_match' ELSE 'bls_peak_mismatch' END AS topn FROM injections)"""


def injected(spark, d):
    k = F.col("injection_id")
    return B.injections(spark, d).withColumns({
        "depth_snr": (k * 13 % 101) / 10.0, "sde_max": (k * 31 % 97) / 4.0, "recovery_status": F.when(k % 4 == 0, "bls_recovered").otherwise("bls_peak_mismatch"),
        "topn_recovery_status": F.when(k % 4 == 0, "bls_top1_recovered").when((k % 4 == 1) & (k % 3 == 0), "bls_topn_harmonic_match").otherwise("bls_peak_mismatch")})


MODES = {"inj_bls_top1_recovered": 30, "inj_topn_or_harmonic": 20, "inj_peak_mismatch_mid_snr": 30, "inj_low_snr_or_expected_missed": 20}
BALANCED = lambda part, share, seed, key="injection_id": f"row_number() OVER (PARTITION BY {part} ORDER BY CAST(rr > {share} AS INTEGER), CASE WHEN rr > {share} THEN 0 ELSE rr END, {dg(seed, key)}, {key})"


@query("injected_quota_pool", INJECTIONS, INJ, sql=f"""
, i1 AS (SELECT * FROM ij WHERE truth_period_d BETWEEN 0.2::DOUBLE AND 12.0::DOUBLE AND n_good_in_transit >= 2),
i2 AS (SELECT *, quantile_cont(depth_snr, 0.35) OVER () AS s35, quantile_cont(sde_max, 0.35) OVER () AS e35, quantile_cont(radius_rearth, 0.25) OVER () AS r25 FROM i1),
i3 AS (SELECT *, CASE WHEN topn = 'bls_topn_harmonic_match' THEN 'inj_topn_or_harmonic' WHEN rec = 'bls_recovered' THEN 'inj_bls_top1_recovered' WHEN depth_snr <= s35 OR sde_max <= e35 OR radius_rearth <= r25 THEN 'inj_low_snr_or_expected_missed' ELSE 'inj_peak_mismatch_mid_snr' END AS m FROM i2),
i4 AS (SELECT *, CASE m {" ".join(f"WHEN '{k}' THEN {v}" for k, v in MODES.items())} END AS q, row_number() OVER (PARTITION BY m, grid_period_bin, grid_radius_bin ORDER BY {dg(4, 'injection_id')}, injection_id) AS rr FROM i3),
i5 AS (SELECT *, ceil(q / (SELECT count(*) FROM (SELECT DISTINCT m, grid_period_bin, grid_radius_bin FROM i3) x WHERE x.m = i4.m)) AS sh FROM i4),
i6 AS (SELECT * FROM i5 QUALIFY {BALANCED('m', 'sh', 4)} <= q),
f1 AS (SELECT *, row_number() OVER (PARTITION BY grid_period_bin, grid_radius_bin ORDER BY {dg(104, 'injection_id')}, injection_id) AS rr FROM i3 WHERE injection_id NOT IN (SELECT injection_id FROM i6)),
f2 AS (SELECT *, ceil((150 - (SELECT count(*) FROM i6)) / (SELECT count(*) FROM (SELECT DISTINCT grid_period_bin, grid_radius_bin FROM f1))) AS sh FROM f1),
f3 AS (SELECT * FROM f2 QUALIFY {BALANCED('1', 'sh', 104)} <= 150 - (SELECT count(*) FROM i6)),
al AS (SELECT injection_id, m AS bk, (SELECT count(*) FROM i3 x WHERE x.m = i6.m) AS av FROM i6 UNION ALL SELECT injection_id, 'inj_balanced_fill', (SELECT count(*) FROM i3) FROM f3)
SELECT injection_id, bk AS selection_bucket, round(av / count(*) OVER (PARTITION BY bk), 8) AS selection_weight FROM al""")
def injected_quota_pool(spark, d):
    p = Q.injected_pool(injected(spark, d), 150, 4, (0.2, 12.0), MODES)
    return p.select("injection_id", "selection_bucket", r("selection_weight", 8).alias("selection_weight"))


EDGES = {"truth_period_d": [0.08, 0.7, 2.0, 4.0, 8.0, 13.1], "radius_rearth": [0.18, 1.7, 5.0, 18.1], "tmag": [0.0, 17.0, 18.0, 19.0, 21.0]}
EDGE_SQL = ", ".join("CASE " + f"WHEN {c} = {e[0]}::DOUBLE THEN 0 " + " ".join(f"WHEN {c} > {a}::DOUBLE AND {c} <= {b}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(e[:-1], e[1:]))) + f" END AS {c}_cell" for c, e in EDGES.items())
CELLS = ", ".join(f"{c}_cell" for c in EDGES)

BOUNDARY = f"""
b1 AS (SELECT *, rec = 'bls_recovered' AS strict, rec = 'bls_recovered' OR topn <> 'bls_peak_mismatch' AS found, {EDGE_SQL} FROM ij),
b2 AS (SELECT {CELLS}, count(*) AS cell_n, avg(CAST(strict AS DOUBLE)) AS cell_strict_frac, avg(CAST(found AS DOUBLE)) AS cell_any_frac FROM b1 WHERE {" AND ".join(f"{c}_cell IS NOT NULL" for c in EDGES)} GROUP BY ALL)"""


@query("boundary_cells", INJECTIONS, INJ, BOUNDARY, sql=f"""
SELECT injection_id, {CELLS}, cell_n, round(cell_strict_frac, 8) AS cell_strict_frac, round(cell_any_frac, 8) AS cell_any_frac, round(abs(cell_any_frac - 0.5::DOUBLE), 8) AS cell_distance FROM b1 LEFT JOIN b2 USING ({CELLS})""")
def boundary_cells(spark, d):
    c = Q.boundary_cells(injected(spark, d), EDGES)
    return c.select("injection_id", *[f"{x}_cell" for x in EDGES], "cell_n", *[r(x, 8).alias(x) for x in ("cell_strict_frac", "cell_any_frac", "cell_distance")])


@query("boundary_sample", INJECTIONS, INJ, BOUNDARY, sql=f"""
, e1 AS (SELECT b1.*, cell_any_frac FROM b1 JOIN b2 USING ({CELLS}) WHERE strict AND cell_any_frac BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE AND n_good_in_transit >= 2 AND injection_id % 10 <> 0),
e2 AS (SELECT *, count(*) OVER (PARTITION BY {CELLS}) AS av, row_number() OVER (PARTITION BY {CELLS} ORDER BY {dg(8, 'injection_id')}, injection_id) AS rr, ceil(60 / (SELECT count(*) FROM (SELECT DISTINCT {CELLS} FROM e1))) AS sh FROM e1),
e3 AS (SELECT * FROM e2 QUALIFY {BALANCED('1', 'sh', 8)} <= 60)
SELECT injection_id, {CELLS}, round(av / count(*) OVER (PARTITION BY {CELLS}), 8) AS selection_weight FROM e3""")
def boundary_sample(spark, d):
    i = injected(spark, d)
    s = Q.boundary_sample(i, EDGES, 60, 8, (0.3, 0.7), excluded=i.where("injection_id % 10 = 0"))
    return s.select("injection_id", *[f"{x}_cell" for x in EDGES], r("selection_weight", 8).alias("selection_weight"))
