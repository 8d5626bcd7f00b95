"""ANSI SQL twins of the domain views, for the result oracle only."""

CADENCES = """
ev AS (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 8.64e10 AS tt FROM events),
cadences AS (
  SELECT 1 AS sector, user_id AS tic, aperture, event_id AS cadenceno, tt AS time,
         CAST(floor(tt / 13.7) AS INTEGER) AS orbitid, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS quality,
         CASE WHEN aperture = 'SML' THEN 1 + (value - 50) / 1000
              ELSE 1 + (value * 0.8 + event_id % 7 - 45) / 1000 END AS flux,
         10 + (event_id % 13) / 100 AS sap_x, 20 + (event_id % 17) / 100 AS sap_y, value / 10 AS bkg
  FROM ev CROSS JOIN (VALUES ('SML'), ('PRI')) ap(aperture))
"""

RAW = """
ev AS (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 8.64e10 AS tt FROM events),
raw_cadences AS (
  SELECT user_id AS tic, CAST(floor(tt / 13.7) AS INTEGER) AS orbit, 1 + user_id % 4 AS camera,
         1 + CAST(floor(user_id / 4) AS BIGINT) % 4 AS ccd, event_id AS cadenceno, tt AS time,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS quality,
         CASE WHEN event_id % 3 <> 0 THEN 100 + value END AS raw_flux,
         17 - 2.5 * log10(1 + value / 100) AS raw_mag, 16 + (user_id % 40) / 10 AS tmag
  FROM ev)
"""

PEAKS = """
peaks AS (
  SELECT l_orderkey AS tic, 1 AS sector, CAST(1 + l_orderkey % 4 AS INTEGER) AS cam, CAST(1 + CAST(floor(l_orderkey / 4) AS BIGINT) % 4 AS INTEGER) AS ccd,
         16 + (l_orderkey % 50) / 10 AS tmag, CASE WHEN l_linestatus = 'F' THEN 'SML' ELSE 'PRI' END AS aperture,
         l_linenumber AS peak_rank,
         CASE l_partkey % 5
           WHEN 0 THEN (0.12::DOUBLE + (l_orderkey % 1500) / 100) * (1 + (l_suppkey % 10 - 5) * 0.0005::DOUBLE)
           WHEN 1 THEN 2 * (0.12::DOUBLE + (l_orderkey % 1500) / 100)
           ELSE 0.12::DOUBLE + (l_partkey % 1500) / 100 END AS period_d,
         CASE WHEN l_partkey % 5 <= 1 THEN 2457000 + (l_orderkey % 50) / 10 + (l_linenumber - 3) / 1440
              ELSE 2457000 + l_quantity / 10 END AS t0_bjd,
         CAST(3 + CAST(l_quantity AS INTEGER) % 28 AS DOUBLE) AS duration_min, l_discount + 0.01::DOUBLE AS depth,
         l_extendedprice / 5000 AS depth_snr, l_extendedprice / 4000 AS sde, l_extendedprice / 100000 AS log_power,
         200 + l_partkey % 900 AS n_cad_kept, 27.0::DOUBLE AS baseline_d, 'ok' AS status, 'run1' AS bls_run_id,
         l_orderkey AS injection_id, l_partkey AS uid_a, l_suppkey AS uid_b
  FROM lineitem)
"""

INJECTIONS = """
injections AS (
  SELECT o_orderkey AS injection_id, o_custkey AS tic, o_orderkey % 8 AS shard_index,
         0.12::DOUBLE + (o_orderkey % 1500) / 100 AS truth_period_d, 2457000 + (o_orderkey % 50) / 10 AS truth_t0_bjd,
         CAST(3 + o_orderkey % 28 AS DOUBLE) AS truth_duration_min,
         0.01::DOUBLE + (CAST(floor(o_totalprice) AS BIGINT) % 90) / 100 AS model_depth,
         16 + (o_orderkey % 50) / 10 AS tmag, 0.5::DOUBLE + (o_orderkey % 40) / 4 AS radius_rearth,
         CAST(floor((o_orderkey % 1500) / 300) AS BIGINT) AS grid_period_bin,
         CAST(floor((o_orderkey % 40) / 8) AS BIGINT) AS grid_radius_bin,
         1 + o_orderkey % 30 AS n_good_in_transit, o_orderpriority AS source_kind
  FROM orders)
"""

CATALOG = """
catalog AS (
  SELECT c_custkey AS source_id, (c_custkey * 37 % 3600) / 10 AS ra, (c_custkey * 53 % 1800) / 10 - 90 AS dec,
         CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 29 - 1) / 10 END AS parallax,
         0.8::DOUBLE + (c_custkey % 10) / 10 AS ruwe, c_custkey % 17 = 0 AS duplicated_source,
         15 + (c_custkey % 50) / 10 AS phot_g_mean_mag,
         CASE WHEN c_custkey % 13 <> 0 THEN 15.3::DOUBLE + (c_custkey % 50) / 10 END AS phot_bp_mean_mag,
         14.8::DOUBLE + (c_custkey % 47) / 10 AS phot_rp_mean_mag, (c_acctbal + 1000) / 11000 AS pwd, c_nationkey AS region
  FROM customer)
"""

OBSERVATIONS = """
observations AS (
  SELECT l_suppkey AS catalog_row, l_suppkey AS source_id,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1994 * 12 AS INTEGER) AS sector,
         CAST(1 + l_linenumber % 4 AS INTEGER) AS camera, CAST(1 + l_partkey % 4 AS INTEGER) AS ccd,
         l_partkey % 2100 + 0.5::DOUBLE AS colpix, l_quantity * 41 % 2050 + 0.25::DOUBLE AS rowpix
  FROM lineitem)
"""

LABEL_LOG = """
label_log AS (
  SELECT conv_id AS row_id, turn AS seq,
         CASE WHEN turn % 5 <> 4 THEN TIMESTAMP '2024-03-01 00:00:00' + CAST(turn * 7 % 5 AS INTEGER) * INTERVAL 1 MINUTE END AS updated_utc,
         CASE role WHEN 'user' THEN 'planet_like' WHEN 'assistant' THEN 'uncertain' ELSE 'skip' END AS label,
         CASE conv_id % 4 WHEN 0 THEN 'p/2' WHEN 1 THEN 'possible harmonic' WHEN 2 THEN '2.5 p maybe' ELSE '' END AS notes
  FROM conversations)
"""

QUEUE = """
queue AS (
  SELECT doc_id AS review_id, doc_id % 700 AS tic, 1 AS sector, 0.12::DOUBLE + (doc_id * 7 % 1500) / 100 AS period_d,
         2457000 + (doc_id % 70) / 10 AS t0_bjd, CAST(3 + doc_id % 28 AS DOUBLE) AS duration_min, source AS source_bucket,
         CASE WHEN lang = 'en' THEN 'real' ELSE 'injected' END AS source_kind, lang AS stratum, n_chars / 100 AS sde_max,
         (doc_id * 13) % 101 / 10 AS depth_snr, 16 + (doc_id % 50) / 10 AS tmag,
         CASE doc_id % 3 WHEN 0 THEN 'SML' WHEN 1 THEN 'SML,PRI' ELSE 'PRI' END AS apertures_agree
  FROM documents)
"""

HUMAN_LABELS = """
human_labels AS (
  SELECT doc_id AS review_id,
         CASE WHEN quality = 1 AND toxic = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'planet_like' ELSE 'eclipsing_binary_or_pceb' END
              WHEN quality = 1 THEN 'wide_transit_like' WHEN toxic = 1 THEN 'skip'
              WHEN doc_id % 2 = 0 THEN 'stellar_variability' ELSE 'uncertain' END AS label,
         doc_id % 2 = 0 AS second_pass
  FROM labels)
"""

SCORES = """
ex AS (SELECT *, exp(CAST(embedding[1] AS DOUBLE)) AS e0, exp(CAST(embedding[2] AS DOUBLE)) AS e1,
              exp(CAST(embedding[3] AS DOUBLE)) AS e2, exp(CAST(embedding[4] AS DOUBLE)) AS e3 FROM embeddings),
scores AS (
  SELECT vec_id AS review_id, vec_id % 211 AS tic, CAST(1 + vec_id % 5 AS INTEGER) AS rep_peak_rank, (vec_id * 31 % 97) / 4 AS sde_max,
         16 + (vec_id % 40) / 10 AS tmag, 0.12::DOUBLE + (vec_id * 11 % 1300) / 100 AS period_d,
         CAST(3 + vec_id % 28 AS DOUBLE) AS duration_min, CAST(1 + vec_id % 3 AS INTEGER) AS sector,
         e0 / (e0 + e1 + e2 + e3) AS p_planet, e1 / (e0 + e1 + e2 + e3) AS p_eb,
         e2 / (e0 + e1 + e2 + e3) AS p_variable, e3 / (e0 + e1 + e2 + e3) AS p_other,
         CAST(label % 4 AS INTEGER) AS truth, CAST((label + vec_id) % 5 AS INTEGER) AS fold
  FROM ex)
"""


def with_views(*views: str, body: str) -> str:
    """``WITH view, view ... body``; shared helper CTEs appear once."""
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n" + body
