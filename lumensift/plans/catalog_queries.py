"""Queries of catalogs, coverage and product comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import exprs as E
from lumensift.operators import align as A, cadence as C, catalog as K, skew
from lumensift.plans.cadence_queries import FOLD_SQL, GOOD, PERIOD, T0, curves
from lumensift.plans.registry import query, r
from lumensift.plans.views import CADENCES, CATALOG, OBSERVATIONS
from lumensift.sources import binding as B

TMAG = ("CASE WHEN phot_bp_mean_mag IS NULL THEN phot_g_mean_mag - 0.430::DOUBLE ELSE phot_g_mean_mag - 0.00522555::DOUBLE * pow(phot_bp_mean_mag - phot_rp_mean_mag, 3) "
        "+ 0.0891337::DOUBLE * pow(phot_bp_mean_mag - phot_rp_mean_mag, 2) - 0.633923::DOUBLE * (phot_bp_mean_mag - phot_rp_mean_mag) + 0.0324473::DOUBLE END")
MASTER = f"""
master AS (SELECT *, pwd > 0.75::DOUBLE AS is_highconf, coalesce(ruwe <= 1.4::DOUBLE AND NOT duplicated_source AND parallax > 0 AND phot_bp_mean_mag IS NOT NULL, false) AS is_quality_ok, {TMAG} AS tmag FROM catalog)"""
NORB = "CASE WHEN sector IN (97, 98) THEN 4 ELSE 2 END"
FIRST = "9 + (sector - 1) * 2 + CASE WHEN sector > 97 THEN 2 ELSE 0 END + CASE WHEN sector > 98 THEN 2 ELSE 0 END"
ORB = f"""
orb AS (SELECT o.*, CAST({FIRST} + k AS INTEGER) AS orbit, colpix <= 50 OR colpix >= 2087 OR rowpix <= 6 OR rowpix >= 2043 AS edge_warn FROM observations o, range(4) x(k) WHERE k < {NORB})"""
TIC = "CASE WHEN source_id % 3 = 0 THEN -1 ELSE source_id + 5000 END"
EXPORT = f"ex AS (SELECT orb.*, m.is_highconf, CASE WHEN m.source_id % 3 = 0 THEN -1 ELSE m.source_id + 5000 END AS tic_id FROM orb JOIN master m ON m.source_id = orb.source_id)"


def master(spark, d):
    return K.master_catalog(B.catalog(spark, d))


def obs(spark, d):
    return K.expand_orbits(B.observations(spark, d)).withColumn("edge_warn", E.edge_warn("colpix", "rowpix"))


def export(spark, d):
    m = master(spark, d).withColumn("tic_id", F.when(F.col("source_id") % 3 == 0, F.lit(-1)).otherwise(F.col("source_id") + 5000))
    return K.export_table(m, obs(spark, d))


@query("master_catalog", CATALOG, MASTER, sql="SELECT source_id, is_highconf, is_quality_ok, round(tmag, 8) AS tmag, 'unresolved' AS tic_match_status FROM master")
def master_catalog(spark, d):
    return master(spark, d).select("source_id", "is_highconf", "is_quality_ok", r("tmag", 8).alias("tmag"), "tic_match_status")


@query("catalog_manifest", CATALOG, MASTER, sql="""
SELECT 'v0' AS build_version, count(*) AS n_rows, count(*) FILTER (WHERE is_highconf) AS n_highconf, count(*) FILTER (WHERE is_quality_ok) AS n_quality_ok, count(*) FILTER (WHERE is_highconf AND is_quality_ok) AS n_both FROM master""")
def catalog_manifest(spark, d):
    return K.manifest(master(spark, d), "v0")


@query("galactic_coordinates", CATALOG, sql="""
, v AS (SELECT source_id, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM catalog)
SELECT source_id, round(-degrees(atan2(0.4941094278755837::DOUBLE * x - 0.4448296299600112::DOUBLE * y + 0.7469822444972189::DOUBLE * z, -0.0548755604162154::DOUBLE * x - 0.8734370902348850::DOUBLE * y - 0.4838350155487132::DOUBLE * z)), 6) AS lon,
  round(degrees(asin(greatest(-1, least(1, -0.8676661490190047::DOUBLE * x - 0.1980763734312015::DOUBLE * y + 0.4559837761750669::DOUBLE * z)))), 6) AS lat FROM v""")
def galactic_coordinates(spark, d):
    lon, lat = E.galactic("ra", "dec")
    return B.catalog(spark, d).select("source_id", r(lon).alias("lon"), r(lat).alias("lat"))


@query("orbit_expansion", OBSERVATIONS, ORB, sql="SELECT sector, orbit, camera, ccd, count(*) AS n, count(*) FILTER (WHERE edge_warn) AS n_edge FROM orb GROUP BY ALL")
def orbit_expansion(spark, d):
    return obs(spark, d).groupBy("sector", "orbit", "camera", "ccd").agg(F.count(F.lit(1)).alias("n"), F.count_if("edge_warn").alias("n_edge"))


@query("observed_sector_orbits", OBSERVATIONS, sql=f"""
, s AS (SELECT DISTINCT sector FROM observations)
SELECT sector, CAST({FIRST} + k AS INTEGER) AS orbit FROM s, range(4) x(k) WHERE k < {NORB}""")
def observed_sector_orbits(spark, d):
    top = B.observations(spark, d).agg(F.max("sector")).first()[0]
    return K.sector_orbits(spark, int(top)).join(B.observations(spark, d).select("sector").distinct(), "sector", "left_semi")


@query("coverage_payload", OBSERVATIONS, ORB, sql="""
SELECT catalog_row, count(*) AS n_observations, count(DISTINCT sector) AS n_sectors, count(DISTINCT orbit) AS n_orbits, min(sector) AS sector_min, max(sector) AS sector_max, min(orbit) AS orbit_min, max(orbit) AS orbit_max,
  count(*) AS n_json, min({'s': sector, 'o': orbit, 'c': camera, 'd': ccd, 'x': colpix}).x AS first_colpix FROM orb GROUP BY ALL""")
def coverage_payload(spark, d):
    p = K.coverage_payload(obs(spark, d))
    parsed = F.from_json("observations_json", "array<struct<sector:int,orbit:int,camera:int,ccd:int,colpix:double,rowpix:double,edge_warn:boolean>>")
    return p.withColumn("j", parsed).select("catalog_row", "n_observations", "n_sectors", "n_orbits", "sector_min", "sector_max", "orbit_min", "orbit_max",
                                            F.size("j").cast("bigint").alias("n_json"), F.col("j")[0]["colpix"].alias("first_colpix"))


@query("coverage_attached_catalog", CATALOG, OBSERVATIONS, ORB, sql="""
, p AS (SELECT catalog_row, count(*) AS n, count(DISTINCT sector) AS ns, min(sector) AS lo FROM orb GROUP BY ALL)
SELECT source_id, n IS NOT NULL AS has_coverage, coalesce(n, 0) AS n_observations, coalesce(ns, 0) AS n_sectors, coalesce(lo, -1) AS sector_min, n IS NULL AS empty_json FROM catalog LEFT JOIN p ON p.catalog_row = source_id""")
def coverage_attached_catalog(spark, d):
    a = K.attach_coverage(master(spark, d), K.coverage_payload(obs(spark, d)))
    return a.select("source_id", "has_coverage", "n_observations", "n_sectors", "sector_min", (F.col("observations_json") == "[]").alias("empty_json"))


@query("observation_export", CATALOG, MASTER, OBSERVATIONS, ORB, EXPORT, sql="SELECT source_id, sector, orbit, camera, ccd, colpix, tic_id, is_highconf FROM ex")
def observation_export(spark, d):
    return export(spark, d).select("source_id", "sector", "orbit", "camera", "ccd", "colpix", "tic_id", "is_highconf")


@query("detector_summary", CATALOG, MASTER, OBSERVATIONS, ORB, EXPORT, sql="""
SELECT orbit, sector, camera, ccd, count(*) AS n_targets_all, count(*) FILTER (WHERE tic_id > 0) AS n_targets_unique_tic, count(*) FILTER (WHERE is_highconf) AS n_targets_highconf,
 count(*) FILTER (WHERE is_highconf AND tic_id > 0) AS n_targets_highconf_unique_tic FROM ex GROUP BY ALL""")
def detector_summary(spark, d):
    return K.detector_summary(export(spark, d))


@query("sector_summary", CATALOG, MASTER, OBSERVATIONS, ORB, EXPORT, sql="""
SELECT sector, count(DISTINCT source_id) AS n_unique_targets_all, count(DISTINCT CASE WHEN tic_id > 0 THEN source_id END) AS n_unique_targets_unique_tic, count(DISTINCT CASE WHEN is_highconf THEN source_id END) AS n_unique_targets_highconf,
 count(DISTINCT CASE WHEN is_highconf AND tic_id > 0 THEN source_id END) AS n_unique_targets_highconf_unique_tic, count(*) AS n_detector_target_rows, count(DISTINCT (orbit, camera, ccd)) AS n_orbit_detector_footprints FROM ex GROUP BY ALL""")
def sector_summary(spark, d):
    return K.sector_summary(export(spark, d))


@query("observed_sector_counts", OBSERVATIONS, sql="SELECT source_id, count(DISTINCT CASE WHEN sector <= 40 THEN sector END) AS observed, count(DISTINCT sector) AS total FROM observations GROUP BY ALL")
def observed_sector_counts(spark, d):
    return K.observed_counts(B.observations(spark, d), 40)


@query("coverage_summary", CATALOG, OBSERVATIONS, sql="""
, c AS (SELECT source_id, count(*) FILTER (WHERE sector <= 40) AS o FROM observations GROUP BY ALL)
SELECT count(*) AS n_targets, count(CASE WHEN o > 0 THEN o END) AS n_nonzero, median(CASE WHEN o > 0 THEN o END) AS median_positive, max(o) AS max_observed FROM catalog LEFT JOIN c USING (source_id)""")
def coverage_summary(spark, d):
    return K.coverage_summary(B.catalog(spark, d), K.observed_counts(B.observations(spark, d), 40, "rows"))


@query("probability_bin_summary", CATALOG, sql="""
, b AS (SELECT CASE WHEN pwd >= 0 AND pwd < 0.25 THEN '0.00-0.25' WHEN pwd >= 0.25 AND pwd < 0.5 THEN '0.25-0.50' WHEN pwd >= 0.5 AND pwd <= 0.75 THEN '0.50-0.75' WHEN pwd > 0.75 AND pwd <= 1 THEN '0.75-1.00' END AS pwd_bin,
  CASE WHEN parallax > 0 THEN 1000.0::DOUBLE / parallax END AS pc FROM catalog)
SELECT pwd_bin, count(*) AS n, round(median(pc), 6) AS median_pc, round(quantile_cont(pc, 0.95), 6) AS p95_pc FROM b WHERE pwd_bin IS NOT NULL GROUP BY ALL""")
def probability_bin_summary(spark, d):
    return K.probability_bin_summary(B.catalog(spark, d)).withColumns({k: r(k) for k in ("median_pc", "p95_pc")})


BRIDGE = """
h1 AS (SELECT s_suppkey AS source_id, s_suppkey * 10 + k AS dr2_id FROM supplier, range(2) x(k) WHERE s_suppkey % 4 <> 0 AND k <= s_suppkey % 2),
h2 AS (SELECT p_partkey AS dr2_id, p_partkey % 500 + 7000 AS tic FROM part WHERE p_partkey % 3 <> 0),
br AS (SELECT s_suppkey AS source_id, count(DISTINCT h1.dr2_id) AS n_dr2, count(DISTINCT tic) AS n_tic, min(tic) AS tic0 FROM supplier LEFT JOIN h1 ON h1.source_id = s_suppkey LEFT JOIN h2 ON h2.dr2_id = h1.dr2_id GROUP BY ALL),
bs AS (SELECT source_id, CAST(n_dr2 AS INTEGER) AS n_dr2, CAST(n_tic AS INTEGER) AS n_tic, CASE WHEN n_dr2 = 0 THEN 'no_dr2_match' WHEN n_tic = 0 THEN 'dr2_no_tic' WHEN n_tic = 1 THEN 'unique_tic' ELSE 'multiple_tic' END AS status, CASE WHEN n_tic = 1 THEN tic0 END AS tic FROM br)"""


def bridge(spark, d):
    s, p = B.table(spark, d, "supplier"), B.table(spark, d, "part")
    k = F.col("s_suppkey")
    h1 = s.where(k % 4 != 0).select(k.alias("source_id"), F.explode(F.sequence(F.lit(0), (k % 2).cast("int"))).alias("k"))
    h1 = h1.select("source_id", (F.col("source_id") * 10 + F.col("k")).alias("dr2_id"))
    h2 = p.where(F.col("p_partkey") % 3 != 0).select(F.col("p_partkey").alias("dr2_id"), (F.col("p_partkey") % 500 + 7000).alias("tic"))
    return K.bridge_match(s.select(k.alias("source_id")), h1, h2)


@query("two_hop_bridge", BRIDGE, sql="SELECT * FROM bs")
def two_hop_bridge(spark, d):
    return bridge(spark, d).select("source_id", "n_dr2", "n_tic", "status", "tic")


@query("match_status_merge", CATALOG, BRIDGE, sql="""
, j AS (SELECT c.source_id, coalesce(CASE WHEN c.source_id % 20 = 1 THEN 'garbled' ELSE status END, 'unresolved') AS st, tic FROM catalog c LEFT JOIN bs ON bs.source_id = c.source_id),
k AS (SELECT source_id, CASE WHEN st = 'garbled' THEN 'unknown' ELSE st END AS st, tic FROM j)
SELECT source_id, st AS tic_match_status, CASE WHEN st = 'unique_tic' AND tic IS NOT NULL THEN tic ELSE -1 END AS tic_id FROM k""")
def match_status_merge(spark, d):
    s = bridge(spark, d)
    c = B.catalog(spark, d)
    garbled = c.where(F.col("source_id") % 20 == 1).select("source_id", F.lit("garbled").alias("status"), F.lit(None).cast("bigint").alias("tic"))
    s = s.where(F.col("source_id") % 20 != 1).select("source_id", "status", "tic").unionByName(garbled)
    return K.merge_status(c, s).select("source_id", "tic_match_status", "tic_id")


@query("match_status_counters", CATALOG, BRIDGE, sql="""
, j AS (SELECT coalesce(status, 'unresolved') AS st, CASE WHEN status = 'unique_tic' THEN tic ELSE -1 END AS t FROM catalog c LEFT JOIN bs ON bs.source_id = c.source_id)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE st = 'no_dr2_match') AS n_no_dr2_match, count(*) FILTER (WHERE st = 'dr2_no_tic') AS n_dr2_no_tic, count(*) FILTER (WHERE st = 'unique_tic') AS n_unique_tic,
 count(*) FILTER (WHERE st = 'multiple_tic') AS n_multiple_tic, CAST(0 AS BIGINT) AS n_unknown, count(*) FILTER (WHERE st = 'unresolved') AS n_unresolved, count(*) FILTER (WHERE t > 0) AS n_with_tic FROM j""")
def match_status_counters(spark, d):
    return K.status_counters(K.merge_status(B.catalog(spark, d), bridge(spark, d)))


@query("tile_overlay", OBSERVATIONS, sql="""
SELECT CAST(gx AS BIGINT) AS grid_x, CAST(gy AS BIGINT) AS grid_y, count(*) AS n FROM observations, range(14) a(gx), range(14) b(gy)
WHERE colpix BETWEEN gx * 146 + 44 AND gx * 146 + 44 + 149 AND rowpix BETWEEN gy * 146 AND gy * 146 + 149 GROUP BY ALL""")
def tile_overlay(spark, d):
    return K.tile_overlay(B.observations(spark, d), 14, 14, 150, 2).groupBy("grid_x", "grid_y").agg(F.count(F.lit(1)).alias("n"))


@query("source_target_table", CATALOG, MASTER, OBSERVATIONS, sql="SELECT source_id, round(tmag, 8) AS tmag FROM master WHERE source_id IN (SELECT source_id FROM observations) AND tmag <= 18 ORDER BY master.tmag, source_id LIMIT 50")
def source_target_table(spark, d):
    return K.source_targets(master(spark, d), B.observations(spark, d), 18.0, 50).select("source_id", r("tmag", 8).alias("tmag"))


POINTINGS = ((1, 40.0, -50.0), (2, 130.0, -10.0), (3, 220.0, 30.0), (4, 310.0, 60.0))


@query("pointing_coverage", CATALOG, sql=f"""
, p(sector, pra, pdec) AS (VALUES {", ".join(f"({s}, {a}::DOUBLE, {b}::DOUBLE)" for s, a, b in POINTINGS)}),
s AS (SELECT source_id, sector, degrees(acos(greatest(-1, least(1, sin(radians(dec)) * sin(radians(pdec)) + cos(radians(dec)) * cos(radians(pdec)) * cos(radians(ra) - radians(pra)))))) AS sep FROM catalog, p)
SELECT source_id, sector, round(sep, 5) AS sep_deg FROM s WHERE sep <= 35""")
def pointing_coverage(spark, d):
    return K.pointing_join(B.catalog(spark, d), POINTINGS, 35.0).select("source_id", "sector", r("sep_deg", 5).alias("sep_deg"))


@query("star_enrichment", CATALOG, sql="""
, q AS (SELECT DISTINCT o_custkey % 700 AS tic FROM orders), s0 AS (SELECT source_id % 500 AS tic, min(source_id) AS source_id FROM catalog GROUP BY ALL),
s AS (SELECT tic, CASE WHEN source_id % 4 <> 0 THEN 'h' WHEN source_id % 8 <> 0 THEN 'he' END AS a, CASE WHEN source_id % 4 <> 0 THEN 0.5::DOUBLE + (source_id % 5) / 10 ELSE 0.55::DOUBLE END AS m, CASE WHEN source_id % 4 <> 0 THEN 7.9::DOUBLE + (source_id % 3) / 10 ELSE 8.0::DOUBLE END AS g FROM s0),
e AS (SELECT q.tic, coalesce(a, 'default') AS star_source, CASE WHEN a IS NULL THEN 0.6::DOUBLE ELSE m END AS star_mass, CASE WHEN a IS NULL THEN 0.013::DOUBLE ELSE sqrt(m * 1.32712440e20 / (pow(10, g) / 100)) / 6.957e8 END AS star_radius FROM q LEFT JOIN s ON s.tic = q.tic)
SELECT tic, star_source, round(star_mass, 6) AS star_mass, round(star_radius, 8) AS star_radius FROM e""")
def star_enrichment(spark, d):
    q = B.table(spark, d, "orders").select((F.col("o_custkey") % 700).alias("tic")).distinct()
    k = F.col("source_id")
    s = B.catalog(spark, d).select((k % 500).alias("tic"), "source_id", F.when(k % 4 != 0, 0.5 + (k % 5) / 10).alias("h_mass"), F.when(k % 4 != 0, 7.9 + (k % 3) / 10).alias("h_logg"),
                                   F.when(k % 8 != 0, 0.55).alias("he_mass"), F.when(k % 8 != 0, 8.0).alias("he_logg"))
    return K.enrich_stars(q, s, ["h", "he"]).select("tic", "star_source", r("star_mass").alias("star_mass"), r("star_radius", 8).alias("star_radius"))


@query("product_completeness", CATALOG, OBSERVATIONS, ORB, sql="""
, e AS (SELECT orbit, ccd, source_id, bool_or(edge_warn) AS edge_warn FROM orb GROUP BY ALL),
f AS (SELECT orbit, ccd, source_id, CASE WHEN source_id % 9 = 0 THEN 0 ELSE 10 END AS length FROM e WHERE (source_id + ccd) % 7 <> 0 UNION ALL SELECT orbit, ccd, -1, 10 FROM e GROUP BY ALL),
j AS (SELECT coalesce(e.orbit, f.orbit) AS orbit, coalesce(e.ccd, f.ccd) AS ccd, e.source_id IS NOT NULL AS ie, f.source_id IS NOT NULL AS jf, coalesce(edge_warn, false) AS edge, length FROM e FULL JOIN f ON e.orbit = f.orbit AND e.ccd = f.ccd AND e.source_id = f.source_id)
SELECT CAST(orbit AS INTEGER) AS orbit, CAST(ccd AS INTEGER) AS ccd, count(*) FILTER (WHERE ie) AS n_expected, count(*) FILTER (WHERE ie AND jf) AS n_found, count(*) FILTER (WHERE ie AND NOT jf AND edge) AS n_missing_edge,
  count(*) FILTER (WHERE ie AND NOT jf AND NOT edge) AS n_missing, count(*) FILTER (WHERE jf AND length = 0) AS n_empty, count(*) FILTER (WHERE jf AND NOT ie) AS n_extra FROM j GROUP BY GROUPING SETS ((orbit), (ccd), ())""")
def product_completeness(spark, d):
    e = obs(spark, d).groupBy("orbit", "ccd", "source_id").agg(F.bool_or("edge_warn").alias("edge_warn"))
    f = e.where((F.col("source_id") + F.col("ccd")) % 7 != 0).select("orbit", "ccd", "source_id", F.when(F.col("source_id") % 9 == 0, 0).otherwise(10).alias("length"))
    f = f.unionByName(e.select("orbit", "ccd").distinct().select("orbit", "ccd", F.lit(-1).cast("bigint").alias("source_id"), F.lit(10).alias("length")))
    return K.completeness(e, f, ["orbit", "ccd", "source_id"], [["orbit"], ["ccd"], []])


@query("cadence_authority_filter", CADENCES, sql="""
, j AS (SELECT tic, cadenceno, cadenceno % 50 <> 7 AS ok FROM cadences WHERE aperture = 'SML'), l AS (SELECT tic, count(*) FILTER (WHERE NOT ok) AS n_dropped FROM j GROUP BY ALL)
SELECT j.tic, count(*) AS n_kept, any_value(n_dropped) AS n_dropped, any_value(n_dropped) <= 2 AS drop_ok FROM j JOIN l ON l.tic = j.tic WHERE ok GROUP BY ALL""")
def cadence_authority_filter(spark, d):
    c = B.cadences(spark, d).where(F.col("aperture") == "SML").select("tic", "cadenceno")
    a = B.table(spark, d, "events").where(F.col("event_id") % 50 != 7).select(F.col("event_id").alias("cadenceno"))
    return K.drop_unlisted(c, a, ["cadenceno"], 2).groupBy("tic").agg(F.count(F.lit(1)).alias("n_kept"), F.first("n_dropped").alias("n_dropped"), F.first("drop_ok").alias("drop_ok"))


@query("cadence_reconciliation", CADENCES, sql="""
, e AS (SELECT sector, cadenceno, orbitid FROM cadences WHERE aperture = 'SML' AND cadenceno % 11 <> 3), q AS (SELECT sector, cadenceno, CASE WHEN cadenceno % 101 = 0 THEN orbitid + 1 ELSE orbitid END AS orbitid FROM cadences WHERE aperture = 'PRI' AND cadenceno % 13 <> 5)
SELECT CASE WHEN q.cadenceno IS NULL THEN 'left_only' WHEN e.cadenceno IS NULL THEN 'right_only' WHEN e.orbitid <> q.orbitid THEN 'orbitid_mismatch' ELSE 'both' END AS state, count(*) AS n FROM e FULL JOIN q ON e.sector = q.sector AND e.cadenceno = q.cadenceno GROUP BY ALL""")
def cadence_reconciliation(spark, d):
    c = B.cadences(spark, d)
    e = c.where((F.col("aperture") == "SML") & (F.col("cadenceno") % 11 != 3)).select("sector", "cadenceno", "orbitid")
    q = c.where((F.col("aperture") == "PRI") & (F.col("cadenceno") % 13 != 5)).select("sector", "cadenceno", F.when(F.col("cadenceno") % 101 == 0, F.col("orbitid") + 1).otherwise(F.col("orbitid")).alias("orbitid"))
    return A.reconcile(e, q, ["sector", "cadenceno"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("aligned_by_cadence", CADENCES, sql="""
, q AS (SELECT tic, cadenceno, time FROM cadences WHERE aperture = 'SML'), w AS (SELECT tic, cadenceno, time + CASE WHEN cadenceno % 97 = 0 THEN 0.001::DOUBLE ELSE 0 END AS rt FROM cadences WHERE aperture = 'PRI' AND cadenceno % 19 <> 4)
SELECT CASE WHEN rt IS NULL THEN 'missing' WHEN abs(time - rt) * 86400 > 2 THEN 'time_error' ELSE 'ok' END AS state, count(*) AS n FROM q LEFT JOIN w ON q.tic = w.tic AND q.cadenceno = w.cadenceno GROUP BY ALL""")
def aligned_by_cadence(spark, d):
    c = B.cadences(spark, d)
    q = c.where(F.col("aperture") == "SML").select("tic", "cadenceno", "time")
    w = c.where((F.col("aperture") == "PRI") & (F.col("cadenceno") % 19 != 4)).withColumn("time", F.col("time") + F.when(F.col("cadenceno") % 97 == 0, 0.001).otherwise(0.0))
    return A.align_by_cadence(q, w).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("nearest_time_join", CADENCES, sql="""
, l AS (SELECT tic, cadenceno, time FROM cadences WHERE aperture = 'SML' AND cadenceno % 3 = 0), w AS (SELECT tic, cadenceno AS rc, time AS rt FROM cadences WHERE aperture = 'PRI' AND cadenceno % 3 <> 0),
j AS (SELECT l.*, rc, rt, row_number() OVER (PARTITION BY l.tic, l.cadenceno ORDER BY abs(l.time - rt), rt) AS rn FROM l LEFT JOIN w ON w.tic = l.tic)
SELECT tic, cadenceno, rc AS match_cadenceno, round(abs(time - rt) * 86400, 3) AS dt_s FROM j WHERE rn = 1""")
def nearest_time_join(spark, d):
    c = B.cadences(spark, d)
    l = c.where((F.col("aperture") == "SML") & (F.col("cadenceno") % 3 == 0))
    w = c.where((F.col("aperture") == "PRI") & (F.col("cadenceno") % 3 != 0))
    hot = skew.has_hot_group(B.table(spark, d, "events"), ["user_id"])
    n = A.nearest_time(l, w, ["tic"], ["cadenceno"], ["cadenceno"], hot=hot)
    return n.select("tic", "cadenceno", "match_cadenceno", r("dt_s", 3).alias("dt_s"))


@query("matched_product_depths", CADENCES, GOOD, sql=f"""
, a AS (SELECT tic, aperture, cadenceno, time, flux AS cur FROM g), b AS (SELECT tic, aperture, cadenceno, flux * 1.1::DOUBLE + (cadenceno % 5) / 1000 AS ref FROM g WHERE cadenceno % 17 <> 2),
j AS (SELECT a.*, ref, abs({FOLD_SQL}) * 1440 <= 150 AS ins FROM a JOIN b USING (tic, aperture, cadenceno)),
m AS (SELECT *, median(CASE WHEN NOT ins THEN cur END) OVER w AS co, median(CASE WHEN NOT ins THEN ref END) OVER w AS ro FROM j WINDOW w AS (PARTITION BY tic, aperture))
SELECT tic, aperture, count(*) AS n_common, count(*) FILTER (WHERE ins) AS n_in, round((any_value(co) - median(CASE WHEN ins THEN cur END)) / any_value(co), 8) AS cur_depth, round((any_value(ro) - median(CASE WHEN ins THEN ref END)) / any_value(ro), 8) AS ref_depth,
  round(median(CASE WHEN NOT ins THEN abs(cur - co) END), 8) AS cur_mad FROM m GROUP BY ALL""")
def matched_product_depths(spark, d):
    c, hot = curves(spark, d)
    ref = c.where(F.col("cadenceno") % 17 != 2).withColumn("flux", F.col("flux") * 1.1 + (F.col("cadenceno") % 5) / 1000)
    m = A.matched_products(c, ref, F.lit(PERIOD), F.lit(T0), F.lit(300.0), hot=hot)
    return m.select("tic", "aperture", "n_common", "n_in", *[r(k, 8).alias(k) for k in ("cur_depth", "ref_depth", "cur_mad")])


@query("cross_tree_comparison", CADENCES, GOOD, sql="""
, b AS (SELECT tic, orbitid, aperture, cadenceno, flux * 1.1::DOUBLE + (cadenceno % 5) / 100 AS fb FROM g WHERE tic % 10 <> 3), j AS (SELECT g.tic, g.orbitid, g.aperture, flux AS fa, fb FROM g JOIN b USING (tic, orbitid, aperture, cadenceno)),
n AS (SELECT *, fa / median(fa) OVER w AS na, fb / median(fb) OVER w AS nb FROM j WINDOW w AS (PARTITION BY tic, orbitid, aperture)), dd AS (SELECT *, na - nb AS d, median(na - nb) OVER (PARTITION BY tic, orbitid, aperture) AS dm FROM n),
s AS (SELECT tic, orbitid, aperture, count(*) AS n, corr(na, nb) AS c, median(abs(d - dm)) AS dv FROM dd GROUP BY ALL), e AS (SELECT DISTINCT tic, orbitid, aperture FROM g)
SELECT e.tic, e.orbitid, e.aperture, coalesce(n, 0) AS n_common, CASE WHEN e.tic % 10 = 3 THEN 'missing_path' WHEN coalesce(n, 0) < 20 THEN 'insufficient_overlap' ELSE 'ok' END AS status, CASE WHEN n >= 20 THEN round(c, 6) END AS correlation, CASE WHEN n >= 20 THEN round(1.4826 * dv * 1e6, 3) END AS difference_mad_ppm
FROM e LEFT JOIN s USING (tic, orbitid, aperture)""")
def cross_tree_comparison(spark, d):
    c, hot = curves(spark, d)
    b = c.where(F.col("tic") % 10 != 3).withColumn("flux", F.col("flux") * 1.1 + (F.col("cadenceno") % 5) / 100)
    t = A.compare_trees(c, b, hot=hot)
    return t.select("tic", "orbitid", "aperture", "n_common", "status", r("correlation").alias("correlation"), r("difference_mad_ppm", 3).alias("difference_mad_ppm"))


@query("product_parity", CADENCES, sql="""
, b AS (SELECT tic, aperture, cadenceno, CASE WHEN cadenceno % 31 = 0 THEN flux + 1e-6 ELSE flux END AS f2, quality AS q2 FROM cadences WHERE cadenceno % 29 <> 1),
j AS (SELECT a.tic, flux, f2, b.tic IS NULL AS miss FROM cadences a LEFT JOIN b ON a.tic = b.tic AND a.aperture = b.aperture AND a.cadenceno = b.cadenceno)
SELECT tic, count(*) FILTER (WHERE miss) AS n_missing, CAST(0 AS BIGINT) AS n_extra, count(*) FILTER (WHERE NOT miss AND flux <> f2) AS flux_mismatches, CAST(0 AS BIGINT) AS quality_mismatches FROM j GROUP BY ALL""")
def product_parity(spark, d):
    c = B.cadences(spark, d)
    b = c.where(F.col("cadenceno") % 29 != 1).withColumn("flux", F.when(F.col("cadenceno") % 31 == 0, F.col("flux") + 1e-6).otherwise(F.col("flux")))
    return A.product_parity(c, b, ["flux", "quality"])
