"""Queries of selection, splits and label handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import exprs as E, hashing as H
from lumensift.operators import labels as L, ordering as O, select as S, splits as P
from lumensift.plans.registry import query, r
from lumensift.plans.views import HUMAN_LABELS, INJECTIONS, LABEL_LOG, PEAKS, QUEUE, SCORES
from lumensift.sources import binding as B

dg = lambda seed, c: f"sha256('{seed}|' || CAST({c} AS VARCHAR))"
mod8 = lambda hexed, n: f"CAST(((('0x' || substr({hexed}, 1, 8))::BIGINT % {n}) * {2**32 % n} + ('0x' || substr({hexed}, 9, 8))::BIGINT) % {n} AS BIGINT)"


@query("stable_hash_folds", INJECTIONS, sql=f"""
SELECT injection_id, {dg(7, 'injection_id')} AS digest, {mod8(dg(7, 'injection_id'), 5)} AS fold, {mod8("sha1(CAST(injection_id AS VARCHAR))", 40)} AS shard,
  CASE WHEN ('0x' || substr(sha1(CAST(tic AS VARCHAR)), 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(sha1(CAST(tic AS VARCHAR)), 1, 8))::BIGINT % 100 < 85 THEN 'validation' ELSE 'test' END AS split FROM injections""")
def stable_hash_folds(spark, d):
    k = F.col("injection_id")
    return B.injections(spark, d).select(k, H.digest(k, 7).alias("digest"), H.stable_fold(k, 7, 5).alias("fold"), H.stable_shard(k, 40).alias("shard"), H.split_of(F.col("tic")).alias("split"))


@query("top_unique_targets", SCORES, sql="""
, b AS (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY p_eb DESC, sde_max DESC, rep_peak_rank, review_id) AS rn FROM scores)
SELECT tic, review_id, CAST(row_number() OVER (ORDER BY p_eb DESC, sde_max DESC, rep_peak_rank, tic) AS INTEGER) AS selection_rank FROM b WHERE rn = 1 ORDER BY selection_rank LIMIT 60""")
def top_unique_targets(spark, d):
    return S.top_unique(B.scores(spark, d), "p_eb", 60).select("tic", "review_id", "selection_rank")


CONTROL = """
cb AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY tic ORDER BY rep_peak_rank, sde_max DESC, review_id) = 1),
cq AS (SELECT *, CAST(floor(4 * (row_number() OVER (ORDER BY tmag, tic) - 1) / (SELECT count(*) FROM cb)) AS INTEGER) AS q1, CAST(floor(4 * (row_number() OVER (ORDER BY period_d, tic) - 1) / (SELECT count(*) FROM cb)) AS INTEGER) AS q2,
  CAST(floor(4 * (row_number() OVER (ORDER BY sde_max, tic) - 1) / (SELECT count(*) FROM cb)) AS INTEGER) AS q3 FROM cb),
cr AS (SELECT *, """ + dg(11, "tic") + """ AS h, row_number() OVER (PARTITION BY q1, q2, q3 ORDER BY """ + dg(11, "tic") + """, tic) AS rd FROM cq)"""


@query("stratified_controls", SCORES, CONTROL, sql="SELECT tic, review_id FROM cr ORDER BY rd, h, tic LIMIT 80")
def stratified_controls(spark, d):
    return S.stratified_controls(B.scores(spark, d), 80, 11).select("tic", "review_id")


@query("round_robin_strata", QUEUE, sql=f"""
, h AS (SELECT review_id, source_bucket, {dg(3, 'review_id')} AS h, row_number() OVER (PARTITION BY source_bucket ORDER BY {dg(3, 'review_id')}, review_id) AS rd FROM queue) SELECT review_id, source_bucket FROM h ORDER BY rd, h, review_id LIMIT 150""")
def round_robin_strata(spark, d):
    return S.round_robin(B.queue(spark, d), ["source_bucket"], 150, 3, "review_id").select("review_id", "source_bucket")


@query("stratified_target_sample", PEAKS, sql=f"""
, t AS (SELECT DISTINCT tic, tmag FROM peaks), b AS (SELECT *, CAST(floor(5 * (row_number() OVER (ORDER BY tmag, tic) - 1) / (SELECT count(*) FROM t)) AS INTEGER) AS sample_bin FROM t),
h AS (SELECT *, {dg(5, 'tic')} AS h, row_number() OVER (PARTITION BY sample_bin ORDER BY {dg(5, 'tic')}, tic) AS rn FROM b)
SELECT tic, sample_bin FROM h ORDER BY CASE WHEN rn > 20 + CASE WHEN sample_bin < 2 THEN 1 ELSE 0 END THEN 1 ELSE 0 END, h, tic LIMIT 102""")
def stratified_target_sample(spark, d):
    t = B.peaks(spark, d).select("tic", "tmag").distinct()
    return S.stratified_sample(t, F.col("tmag"), 5, 102, 5, "tic").select("tic", "sample_bin")


@query("capped_class_sample", QUEUE, sql=f"SELECT review_id, stratum FROM queue QUALIFY stratum = 'es' OR row_number() OVER (PARTITION BY stratum ORDER BY {dg(9, 'review_id')}, review_id) <= 40")
def capped_class_sample(spark, d):
    return S.capped_per_class(B.queue(spark, d), "stratum", "es", 40, 9, "review_id").select("review_id", "stratum")


@query("balanced_cell_sample", INJECTIONS, sql=f"""
, h AS (SELECT *, {dg(13, 'injection_id')} AS h, row_number() OVER (PARTITION BY grid_period_bin, grid_radius_bin ORDER BY {dg(13, 'injection_id')}, injection_id) AS rn FROM injections)
SELECT injection_id, grid_period_bin, grid_radius_bin FROM h ORDER BY CASE WHEN rn > 5 THEN 1 ELSE 0 END, CASE WHEN rn > 5 THEN 0 ELSE rn END, h, injection_id LIMIT 110""")
def balanced_cell_sample(spark, d):
    return S.balanced_cells(B.injections(spark, d), ["grid_period_bin", "grid_radius_bin"], 110, 13, "injection_id").select("injection_id", "grid_period_bin", "grid_radius_bin")


@query("selection_scores", SCORES, sql="""
, f AS (SELECT *, duration_min / (period_d * 1440.0::DOUBLE) AS df, p_planet + p_eb AS pr FROM scores),
g AS (SELECT *, (rank() OVER (ORDER BY df) + (count(*) OVER (PARTITION BY df) - 1) / 2) / count(*) OVER () AS pct FROM f)
SELECT review_id, round(0.55 * p_planet + 0.35 * pr + 0.10 * CASE WHEN period_d >= 1 AND sde_max <= 40 THEN 1 ELSE 0 END, 8) AS score_planet, round(pr * pct * (1 - 0.5 * p_eb) * (1 - 0.5 * p_variable), 8) AS score_broad,
  round(0.45 * -(p_planet * ln(p_planet) + p_eb * ln(p_eb) + p_variable * ln(p_variable) + p_other * ln(p_other)) / ln(4), 8) AS score_disagreement, round(p_other + (1 - pr), 8) AS score_control FROM g""")
def selection_scores(spark, d):
    s = S.selection_scores(B.scores(spark, d))
    return s.select("review_id", *[r(c, 8).alias(c) for c in ("score_planet", "score_broad", "score_disagreement", "score_control")])


BUCKETS = [S.Bucket("eb", 30, score="p_eb"), S.Bucket("bright", 20, "tmag < 18", score="sde_max"), S.Bucket("random", 25)]


def _bucket_sql():
    parts, used = [], []
    for i, b in enumerate(BUCKETS):
        skip = "".join(f" AND tic NOT IN (SELECT tic FROM k{j})" for j in used)
        key = (f"{b.score} DESC, " if b.score else "") + dg(21, "review_id")
        parts.append(f"f{i} AS (SELECT * FROM scores WHERE {b.where}{skip} QUALIFY row_number() OVER (PARTITION BY tic ORDER BY {key}, review_id) = 1), "
                     f"k{i} AS (SELECT *, '{b.name}' AS bucket FROM f{i} ORDER BY {key}, tic LIMIT {b.n})")
        used.append(i)
    return ", ".join(parts)


@query("quota_buckets", SCORES, _bucket_sql(), sql=" UNION ALL ".join(f"SELECT tic, review_id, bucket FROM k{i}" for i in range(len(BUCKETS))))
def quota_buckets(spark, d):
    return S.quota_buckets(B.scores(spark, d), BUCKETS, 21).select("tic", "review_id", "bucket")


@query("multi_sector_batch")
def multi_sector_batch(spark, d):
    """Per-sector quotas; a target picked for one sector is out for the next."""
    s, picked = B.scores(spark, d), None
    for sector in (1, 2, 3):
        one = S.quota_buckets(s.where(F.col("sector") == sector), [S.Bucket("eb", 10, score="p_eb"), S.Bucket("control", 10)], 31 + sector, excluded=picked)
        picked = one if picked is None else picked.unionByName(one)
    return picked.select("sector", "tic", "review_id", "bucket")


@query("blinded_public_queue", QUEUE, sql=f"SELECT row_number() OVER (ORDER BY {dg(17, 'review_id')}, review_id) - 1 AS display, review_id, round(period_d, 6) AS period_d FROM queue")
def blinded_public_queue(spark, d):
    pub, _ = S.blinded(B.queue(spark, d), 17, "review_id", ["source_kind", "source_bucket", "stratum"])
    return pub.select("display", "review_id", r("period_d").alias("period_d"))


@query("batch_verification", SCORES, _bucket_sql(), sql=", q AS (" + " UNION ALL ".join(f"SELECT tic, review_id, bucket FROM k{i}" for i in range(len(BUCKETS))) + """)
SELECT 'size' AS rule, count(*) = 75 AS passed FROM q UNION ALL SELECT 'unique_targets', count(DISTINCT tic) = count(*) FROM q UNION ALL SELECT 'keys_match', true UNION ALL SELECT 'nothing_exposed', true
UNION ALL SELECT 'quota_' || bucket, count(*) = CASE bucket WHEN 'eb' THEN 30 WHEN 'bright' THEN 20 ELSE 25 END FROM q GROUP BY bucket""")
def batch_verification(spark, d):
    q = S.quota_buckets(B.scores(spark, d), BUCKETS, 21)
    pub, hid = S.blinded(q, 22, "review_id", ["bucket", "truth"])
    return S.verify_batch(pub, hid, {b.name: b.n for b in BUCKETS}, "review_id", ["bucket", "truth"])


HX = "least(" + ", ".join(f"abs(s.period_d / l.period_d - {f}) / {f}" for f in ("0.5::DOUBLE", "(1.0::DOUBLE / 3.0::DOUBLE)", "2.0::DOUBLE", "3.0::DOUBLE")) + ") <= 0.1"


@query("priority_with_harmonics", SCORES, f"""
o AS (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY p_eb DESC, p_planet DESC, sde_max DESC, review_id) AS rn FROM scores), l AS (SELECT * FROM o WHERE rn = 1),
s2 AS (SELECT s.* FROM o s JOIN l ON l.tic = s.tic WHERE s.rn > 1 AND s.p_eb >= 0.2 AND {HX} QUALIFY row_number() OVER (PARTITION BY s.tic ORDER BY s.rn) = 1),
u AS (SELECT *, 'top_per_tic' AS policy FROM l UNION ALL SELECT *, 'harmonic_secondary_exception' FROM s2)""", sql="""
SELECT review_id, policy, CAST(row_number() OVER (ORDER BY p_eb DESC, p_planet DESC, sde_max DESC, review_id) AS INTEGER) AS priority_rank FROM u ORDER BY priority_rank LIMIT 150""")
def priority_with_harmonics(spark, d):
    s = B.scores(spark, d).withColumns({"p_mean": F.col("p_eb"), "p_std": F.col("p_planet")})
    return S.priority_with_harmonics(s, 150, floor=0.2, tol=0.1).select("review_id", "policy", "priority_rank")


@query("pool_with_exclusions", QUEUE, SCORES, sql="""
, p AS (SELECT review_id, tic, 0 AS s FROM queue WHERE review_id % 2 = 0 UNION ALL SELECT review_id, tic, 1 FROM scores), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY s, tic) = 1),
x AS (SELECT review_id, tic FROM queue WHERE review_id % 10 = 3)
SELECT review_id, tic, CASE WHEN s = 0 THEN 'primary' ELSE 'fallback' END AS source_pool FROM f WHERE review_id NOT IN (SELECT review_id FROM x) AND tic NOT IN (SELECT tic FROM x)""")
def pool_with_exclusions(spark, d):
    q = B.queue(spark, d).select("review_id", "tic")
    return S.pool_with_exclusions(q.where(F.col("review_id") % 2 == 0), B.scores(spark, d).select("review_id", "tic"), q.where(F.col("review_id") % 10 == 3))


@query("allocated_strata_sample")
def allocated_strata_sample(spark, d):
    """Rare strata first, a minimum for the others, proportional rest."""
    return S.allocated_sample(B.queue(spark, d), "stratum", 120, ["es"], 15, 25, 41, "review_id").select("review_id", "stratum")


LAB = "lb AS (SELECT q.*, l.label FROM queue q JOIN human_labels l USING (review_id))"


@query("coverage_deficits", QUEUE, HUMAN_LABELS, LAB, sql="""
, v AS (SELECT DISTINCT 'source_bucket' AS c, source_bucket AS v FROM queue UNION SELECT DISTINCT 'stratum', stratum FROM queue), h AS (SELECT 'source_bucket' AS c, source_bucket AS v, count(*) AS n FROM lb GROUP BY ALL UNION ALL SELECT 'stratum', stratum, count(*) FROM lb GROUP BY ALL)
SELECT v.c AS coverage_column, v.v AS value, coalesce(n, 0) AS labelled_n, greatest(0, 25 - coalesce(n, 0)) AS deficit FROM v LEFT JOIN h ON h.c = v.c AND h.v = v.v""")
def coverage_deficits(spark, d):
    q = B.queue(spark, d)
    lab = q.join(B.human_labels(spark, d).select("review_id"), "review_id", "left_semi")
    return S.coverage_deficits(q, lab, ["source_bucket", "stratum"], 25)


@query("next_rows_to_label", QUEUE, HUMAN_LABELS, LAB, sql="""
, a AS (SELECT source_bucket AS v, count(*) AS n FROM lb GROUP BY ALL), b AS (SELECT stratum AS v, count(*) AS n FROM lb GROUP BY ALL),
s AS (SELECT q.*, greatest(0, 25 - coalesce(a.n, 0)) AS da, greatest(0, 25 - coalesce(b.n, 0)) AS db FROM queue q LEFT JOIN a ON a.v = source_bucket LEFT JOIN b ON b.v = stratum WHERE review_id NOT IN (SELECT review_id FROM lb))
SELECT review_id, da + db AS selection_score, concat_ws(';', CASE WHEN da > 0 THEN 'source_bucket:' || source_bucket || ':' || da END, CASE WHEN db > 0 THEN 'stratum:' || stratum || ':' || db END) AS selection_reason FROM s ORDER BY selection_score DESC, sde_max DESC, tmag, review_id LIMIT 60""")
def next_rows_to_label(spark, d):
    q = B.queue(spark, d)
    lab = q.join(B.human_labels(spark, d).select("review_id"), "review_id", "left_semi")
    return S.next_rows(q, lab, ["source_bucket", "stratum"], 25, 60).select("review_id", F.col("selection_score").cast("bigint").alias("selection_score"), "selection_reason")


@query("parameter_spanning_rows", INJECTIONS, sql="""
, s AS (SELECT i % 5 AS p, (4 * (i % 5) + CAST(floor(i / 5) AS BIGINT)) % 5 AS q, count(*) AS k FROM range(30) x(i) GROUP BY ALL)
SELECT injection_id, grid_period_bin, grid_radius_bin FROM (SELECT *, row_number() OVER (PARTITION BY grid_period_bin, grid_radius_bin ORDER BY injection_id) AS rn FROM injections) JOIN s ON p = grid_period_bin AND q = grid_radius_bin WHERE rn <= k""")
def parameter_spanning_rows(spark, d):
    return S.spanning_rows(B.injections(spark, d), 30, 5, 5, "injection_id").select("injection_id", "grid_period_bin", "grid_radius_bin")


@query("blind_repeat_placement")
def blind_repeat_placement(spark, d):
    q = B.queue(spark, d)
    return S.place_repeats(q, q.where(F.col("stratum") == "en").orderBy("review_id").limit(10), 51, "review_id", edge=30, min_separation=40) \
        .select("display", "review_id", "is_repeat", "occurrence")


@query("host_attempt_cycles", INJECTIONS, sql=f"""
, h AS (SELECT DISTINCT tic FROM injections), c AS (SELECT tic, i AS cycle FROM h, range(3) x(i) WHERE i <= (3000 - 1) // (SELECT count(*) FROM h)), n AS (SELECT *, row_number() OVER (ORDER BY cycle, sha256('61|' || cycle || '|' || tic), tic) AS attempt FROM c)
SELECT tic, CAST(cycle AS INTEGER) AS cycle, attempt FROM n WHERE attempt <= 3000""")
def host_attempt_cycles(spark, d):
    return S.host_cycles(B.injections(spark, d), 3000, 61).select("tic", "cycle", "attempt")


@query("role_registry", INJECTIONS, QUEUE, SCORES, sql="""
, a AS (SELECT DISTINCT tic FROM injections WHERE tic % 3 = 0), b AS (SELECT DISTINCT tic FROM queue), c AS (SELECT DISTINCT tic FROM scores), u AS (SELECT tic FROM a UNION SELECT tic FROM b UNION SELECT tic FROM c)
SELECT tic, tic IN (SELECT tic FROM a) AS in_injection, tic IN (SELECT tic FROM b) AS in_human, tic IN (SELECT tic FROM c) AS in_scored, CASE WHEN tic IN (SELECT tic FROM a) THEN 'injection' WHEN tic IN (SELECT tic FROM b) THEN 'human' ELSE 'scored' END AS role FROM u""")
def role_registry(spark, d):
    return P.union_registry([("injection", B.injections(spark, d).where(F.col("tic") % 3 == 0)), ("human", B.queue(spark, d)), ("scored", B.scores(spark, d))])


@query("rank_in_cell_roles", INJECTIONS, sql=f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY grid_period_bin * 5 + grid_radius_bin ORDER BY {dg(71, 'injection_id')}, injection_id) AS rn FROM injections)
SELECT injection_id, CASE WHEN rn <= 2 THEN 'locked_holdout' ELSE 'development' END AS "partition", CASE WHEN rn <= 2 THEN -1 ELSE {mod8(dg(72, 'injection_id'), 5)} END AS cv_fold FROM k""")
def rank_in_cell_roles(spark, d):
    i = B.injections(spark, d).withColumn("cell", F.col("grid_period_bin") * 5 + F.col("grid_radius_bin"))
    return P.rank_in_cell_roles(i, "cell", "injection_id", 71).select("injection_id", "partition", "cv_fold")


@query("id_disjoint_splits", PEAKS, sql=f"""
, i AS (SELECT DISTINCT injection_id FROM peaks), n AS (SELECT count(*) AS n FROM i), k AS (SELECT injection_id, row_number() OVER (ORDER BY {dg(81, 'injection_id')}, injection_id) AS rn FROM i)
SELECT injection_id, CASE WHEN rn <= round_even(0.2::DOUBLE * n, 0) THEN 'test' WHEN rn <= round_even(0.2::DOUBLE * n, 0) + round_even(0.15::DOUBLE * n, 0) THEN 'validation' ELSE 'train' END AS split FROM k, n""")
def id_disjoint_splits(spark, d):
    return P.disjoint_splits(B.peaks(spark, d).select("injection_id").distinct(), "injection_id", 0.15, 0.2, 81)


@query("stratified_splits", QUEUE, sql=f"""
, k AS (SELECT review_id, count(*) OVER (PARTITION BY stratum, source_bucket) AS n, row_number() OVER (PARTITION BY stratum, source_bucket ORDER BY {dg(91, 'review_id')}, review_id) AS rn FROM queue),
t AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(0.2::DOUBLE * n, 0)) ELSE round_even(0.2::DOUBLE * n, 0) END AS w FROM k), v AS (SELECT *, least(w, n - 1) AS t, CASE WHEN n - w >= 3 THEN greatest(1, round_even(0.2::DOUBLE * n, 0)) ELSE round_even(0.2::DOUBLE * n, 0) END AS v0 FROM t)
SELECT review_id, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + least(v0, greatest(0, n - t - 1)) THEN 'validation' ELSE 'train' END AS split FROM v""")
def stratified_splits(spark, d):
    return P.stratified_splits(B.queue(spark, d), ["stratum", "source_bucket"], "review_id", 0.2, 0.2, 91).select("review_id", "split")


@query("grouped_balanced_folds")
def grouped_balanced_folds(spark, d):
    q = B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", "label"), "review_id")
    return P.grouped_folds(q, "tic", "label", 6, 7).select("review_id", "tic", "label", "fold")


@query("host_disjoint_holdout", INJECTIONS, sql="""
, t AS (SELECT injection_id, tic FROM injections WHERE injection_id % 17 = 0), o AS (SELECT * FROM injections WHERE injection_id NOT IN (SELECT injection_id FROM t) AND tic NOT IN (SELECT tic FROM t)),
c AS (SELECT DISTINCT grid_period_bin, grid_radius_bin FROM injections), k AS (SELECT grid_period_bin, grid_radius_bin, count(*) AS n FROM o GROUP BY ALL)
SELECT c.grid_period_bin, c.grid_radius_bin, coalesce(n, 0) AS n, coalesce(n, 0) >= 5 AS supported FROM c LEFT JOIN k ON k.grid_period_bin = c.grid_period_bin AND k.grid_radius_bin = c.grid_radius_bin""")
def host_disjoint_holdout(spark, d):
    i = B.injections(spark, d)
    return P.host_disjoint_holdout(i, i.where(F.col("injection_id") % 17 == 0), ["grid_period_bin", "grid_radius_bin"], 5)[1]


@query("balanced_shards", INJECTIONS, sql=f"SELECT injection_id, CAST(floor((row_number() OVER (ORDER BY {dg(101, 'injection_id')}, injection_id) - 1) / ceil(count(*) OVER () / 16)) AS INTEGER) AS shard FROM injections")
def balanced_shards(spark, d):
    return P.balanced_shards(B.injections(spark, d).select("injection_id"), 16, "injection_id", 101).select("injection_id", "shard")


@query("hosts_dealt_to_cells", INJECTIONS, sql=f"""
, h AS (SELECT tic, CASE WHEN min(tmag) < 17 THEN 'a' WHEN min(tmag) < 19 THEN 'b' ELSE 'c' END AS s FROM injections GROUP BY tic), p AS (SELECT tic, row_number() OVER (ORDER BY s, {dg(111, 'tic')}, tic) - 1 AS p FROM h), q AS (SELECT *, CAST(floor(p / 400) AS BIGINT) AS slot FROM p)
SELECT tic, CAST((p + slot * 7) % 400 AS INTEGER) AS grid_cell_index, CAST(slot AS INTEGER) AS grid_slot FROM q""")
def hosts_dealt_to_cells(spark, d):
    t = F.min("tmag")
    h = B.injections(spark, d).groupBy("tic").agg(F.when(t < 17, "a").when(t < 19, "b").otherwise("c").alias("s"))
    return P.deal_to_cells(h, "s", 400, None, "tic", 111).select("tic", "grid_cell_index", "grid_slot")


@query("latest_label_per_row", LABEL_LOG, sql="SELECT row_id, seq, label FROM label_log QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY updated_utc DESC NULLS LAST, seq DESC) = 1")
def latest_label_per_row(spark, d):
    return L.latest_labels(B.label_log(spark, d)).select("row_id", "seq", "label")


NUM = lambda c: f"printf('%.15g', {c})"
QKEY = f"tic || '|' || sector || '|' || {NUM('period_d')} || '|' || {NUM('t0_bjd')} || '|' || source_bucket"


@query("normalised_review_queue", QUEUE, sql=f"SELECT review_id, row_number() OVER (ORDER BY sde_max DESC, review_id) - 1 AS row_id, {QKEY} AS candidate_key FROM queue")
def normalised_review_queue(spark, d):
    return L.normalise_queue(B.queue(spark, d), [-F.col("sde_max"), F.col("review_id")]).select("review_id", "row_id", "candidate_key")


@query("queue_with_labels", QUEUE, LABEL_LOG, sql="""
, n AS (SELECT *, row_number() OVER (ORDER BY sde_max DESC, review_id) - 1 AS row_id FROM queue), l AS (SELECT * FROM label_log QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY updated_utc DESC NULLS LAST, seq DESC) = 1)
SELECT review_id, n.row_id, l.label AS label_label, l.seq AS label_seq FROM n LEFT JOIN l ON l.row_id = n.row_id""")
def queue_with_labels(spark, d):
    q = L.normalise_queue(B.queue(spark, d), [-F.col("sde_max"), F.col("review_id")])
    return L.join_latest(q, L.latest_labels(B.label_log(spark, d))).select("review_id", "row_id", "label_label", "label_seq")


@query("label_integrity", QUEUE, LABEL_LOG, sql=f"""
, q AS (SELECT review_id AS row_id, {QKEY} AS k FROM queue), l AS (SELECT row_id, seq FROM label_log)
SELECT (SELECT count(*) FROM (SELECT row_id FROM l GROUP BY ALL HAVING count(*) > 1)) AS n_duplicate, (SELECT count(*) FROM l WHERE row_id NOT IN (SELECT row_id FROM q)) AS n_unknown, (SELECT count(*) FROM l JOIN q USING (row_id) WHERE seq % 2 = 1) AS n_mismatch""")
def label_integrity(spark, d):
    q = B.queue(spark, d).withColumn("candidate_key", E.candidate_key()).withColumn("row_id", F.col("review_id"))
    l = B.label_log(spark, d).join(q.select("row_id", "candidate_key"), "row_id", "left")
    l = l.withColumn("candidate_key", F.when(F.col("seq") % 2 == 1, "other|key").otherwise(F.col("candidate_key")))
    return L.label_integrity(q.select("row_id", "candidate_key"), l)


@query("labels_joined_by_key", QUEUE, HUMAN_LABELS, LAB, sql=f"""
, a AS (SELECT review_id, label, {QKEY} AS k FROM lb), b AS (SELECT review_id AS queue_review_id, {QKEY} AS k FROM queue WHERE review_id % 4 <> 1)
SELECT a.review_id, label, queue_review_id, CASE WHEN queue_review_id IS NULL THEN 'unmatched' ELSE 'matched' END AS join_state FROM a LEFT JOIN b ON a.k = b.k""")
def labels_joined_by_key(spark, d):
    q = B.queue(spark, d)
    lab = q.join(B.human_labels(spark, d).select("review_id", "label"), "review_id")
    return L.join_by_key(lab, q.where(F.col("review_id") % 4 != 1)).select("review_id", "label", "queue_review_id", "join_state")


@query("label_roles", HUMAN_LABELS, sql="""
, n AS (SELECT *, CASE WHEN label = 'skip' THEN '' ELSE label END AS target FROM human_labels), c AS (SELECT target, count(*) AS k FROM n GROUP BY ALL)
SELECT review_id, n.target, label = 'uncertain' AS is_audit, n.target = '' AS is_excluded, k < 60 AND n.target <> '' AS is_rare, n.target <> '' AND k >= 60 AND label <> 'uncertain' AS main_include FROM n JOIN c ON c.target = n.target""")
def label_roles(spark, d):
    return L.label_roles(B.human_labels(spark, d), 60).select("review_id", "target", "is_audit", "is_excluded", "is_rare", "main_include")


@query("refold_annotations", LABEL_LOG, sql="""
SELECT row_id, seq, notes IN ('p/2', 'possible harmonic') AS harmonic_suspect, CASE WHEN notes = 'p/2' THEN 0.5::DOUBLE END AS refold_factor,
  CASE notes WHEN 'p/2' THEN 'half_period_note' WHEN 'possible harmonic' THEN 'harmonic_note' ELSE '' END AS refold_reason, round((1 + row_id % 7) * CASE WHEN notes = 'p/2' THEN 0.5::DOUBLE ELSE 1 END, 6) AS model_period_d FROM label_log""")
def refold_annotations(spark, d):
    l = B.label_log(spark, d).withColumn("period_d", (1 + F.col("row_id") % 7).cast("double"))
    return L.refold_annotations(l).select("row_id", "seq", "harmonic_suspect", "refold_factor", "refold_reason", r("model_period_d").alias("model_period_d"))


@query("period_target_precedence", QUEUE, HUMAN_LABELS, """
pt AS (SELECT review_id, period_d, label, source_kind = 'injected' AS inj, CASE WHEN review_id % 6 = 0 THEN 'p/3' WHEN review_id % 6 = 1 THEN '2p' ELSE '' END AS notes, review_id % 4 <> 0 AS adj, CASE WHEN review_id % 4 = 1 THEN 0.5::DOUBLE WHEN review_id % 4 = 2 THEN 1.0::DOUBLE END AS bf,
   CASE WHEN review_id % 4 = 3 THEN 'unresolved' ELSE 'ok' END AS st, CASE WHEN review_id % 8 = 0 THEN 2.0::DOUBLE END AS lg, period_d * CASE WHEN review_id % 3 = 0 THEN 2.01::DOUBLE ELSE 1.3::DOUBLE END AS tp FROM queue JOIN human_labels USING (review_id)),
p2 AS (SELECT *, label IN ('planet_like', 'eclipsing_binary_or_pceb', 'wide_transit_like') AS tr FROM pt),
p3 AS (SELECT *, CASE WHEN notes <> '' THEN 'note' WHEN inj AND tr AND review_id % 3 = 0 THEN 'injection_truth_harmonic' WHEN inj AND tr THEN 'injection_truth_unresolved' WHEN adj AND st = 'unresolved' THEN 'unresolved' WHEN adj AND bf > 0 THEN 'adjudication_button' WHEN lg > 0 THEN 'legacy_refold' ELSE 'default_p' END AS src FROM p2),
p4 AS (SELECT *, CASE src WHEN 'note' THEN CASE notes WHEN 'p/3' THEN 1.0::DOUBLE / 3.0::DOUBLE ELSE 2.0::DOUBLE END WHEN 'injection_truth_harmonic' THEN 2.0::DOUBLE WHEN 'adjudication_button' THEN bf WHEN 'legacy_refold' THEN lg WHEN 'default_p' THEN 1.0::DOUBLE END AS f FROM p3)""", sql="""
SELECT review_id, src AS period_factor_source, round(f, 8) AS effective_factor, round(period_d * f, 8) AS effective_period_d, CASE WHEN tr THEN CASE WHEN f IS NULL THEN '' WHEN f = 0.5 THEN 'p_over_2' WHEN f = 1 THEN 'p' WHEN f = 2 THEN '2p' ELSE 'p_over_3' END ELSE '' END AS harmonic_target,
  tr AND f IS NOT NULL AND src IN ('legacy_refold', 'adjudication_button', 'note', 'injection_truth_harmonic') AS harmonic_include FROM p4""")
def period_target_precedence(spark, d):
    k = F.col("review_id")
    q = B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", "label"), "review_id").withColumns({
        "is_injected": F.col("source_kind") == "injected", "notes": F.when(k % 6 == 0, "p/3").when(k % 6 == 1, "2p").otherwise(""), "adjudicated": k % 4 != 0,
        "button_factor": F.when(k % 4 == 1, 0.5).when(k % 4 == 2, 1.0), "period_status": F.when(k % 4 == 3, "unresolved").otherwise("ok"), "legacy_factor": F.when(k % 8 == 0, 2.0),
        "truth_period_d": F.col("period_d") * F.when(k % 3 == 0, 2.01).otherwise(1.3)})
    return L.period_targets(q).select("review_id", "period_factor_source", r("effective_factor", 8).alias("effective_factor"), r("effective_period_d", 8).alias("effective_period_d"), "harmonic_target", "harmonic_include")


PAIRS = """
rp AS (SELECT review_id // 2 AS g, CASE WHEN review_id % 2 = 0 THEN 'original' ELSE 'blind_repeat' END AS o, label, CASE WHEN review_id % 5 = 0 THEN '2' ELSE '1' END AS f FROM human_labels),
pr AS (SELECT g AS repeat_group, count(*) AS n_rows, max(CASE WHEN o = 'original' THEN label END) AS ol, max(CASE WHEN o <> 'original' THEN label END) AS rl, max(CASE WHEN o = 'original' THEN f END) AS ofa, max(CASE WHEN o <> 'original' THEN f END) AS rfa FROM rp GROUP BY ALL)"""


def pair_rows(spark, d):
    k = F.col("review_id")
    return B.human_labels(spark, d).select(F.floor(k / 2).alias("repeat_group"), F.when(k % 2 == 0, "original").otherwise("blind_repeat").alias("occurrence"), "label", F.when(k % 5 == 0, "2").otherwise("1").alias("factor"))


@query("repeat_pairs", HUMAN_LABELS, PAIRS, sql="""
SELECT repeat_group, n_rows, ol AS original_label, rl AS repeat_label, ol IS NOT NULL AND rl IS NOT NULL AS complete, coalesce(ol = rl, false) AS label_agreement, ol IS NOT NULL AND rl IS NOT NULL AND ofa IS NOT DISTINCT FROM rfa AS factor_agreement,
  coalesce(ol = rl AND ofa = rfa, false) AS exact_agreement, ol IS NOT NULL AND rl IS NOT NULL AND NOT coalesce(ol = rl AND ofa = rfa, false) AS discordant FROM pr""")
def repeat_pairs(spark, d):
    return L.repeat_pairs(pair_rows(spark, d)).drop("original_factor", "repeat_factor")


@query("repeat_agreement_kappa", HUMAN_LABELS, PAIRS, sql="""
, c AS (SELECT * FROM pr WHERE ol IS NOT NULL AND rl IS NOT NULL), n AS (SELECT count(*) AS n, avg(CASE WHEN ol = rl THEN 1.0::DOUBLE ELSE 0 END) AS o FROM c), e AS (SELECT sum(a * b) AS s FROM (SELECT ol AS l, count(*) AS a FROM c GROUP BY ALL) x JOIN (SELECT rl AS l, count(*) AS b FROM c GROUP BY ALL) y USING (l))
SELECT n AS n_pairs, round(o, 8) AS observed, round(s / (n * n), 8) AS expected, round((o - s / (n * n)) / (1 - s / (n * n)), 8) AS kappa FROM n, e""")
def repeat_agreement_kappa(spark, d):
    return L.agreement(L.repeat_pairs(pair_rows(spark, d))).withColumns({k: r(k, 8) for k in ("observed", "expected", "kappa")})


@query("final_decisions", HUMAN_LABELS, sql="""
, x AS (SELECT review_id // 2 AS u, review_id AS row_id, CASE WHEN review_id % 13 = 0 THEN '' ELSE label END AS label, CASE WHEN review_id % 5 = 0 THEN '2' ELSE '1' END AS f FROM human_labels),
g AS (SELECT u, count(*) AS n, count(*) FILTER (WHERE label <> '') AS nl, count(DISTINCT CASE WHEN label <> '' THEN label END) AS dl, count(DISTINCT CASE WHEN label <> '' THEN f END) AS df, arg_min(label, row_id) FILTER (WHERE label <> '') AS l, arg_min(f, row_id) FILTER (WHERE label <> '') AS ff FROM x GROUP BY ALL),
s AS (SELECT *, CASE WHEN n = 1 AND nl = 1 THEN 'single_review' WHEN n = 2 AND nl = 2 AND dl = 1 AND df = 1 THEN 'blind_repeat_agreement' WHEN n = 2 AND nl = 2 AND u % 2 = 0 THEN 'third_pass_resolution' ELSE '' END AS src FROM g)
SELECT u AS source_uid, CASE src WHEN 'third_pass_resolution' THEN 'uncertain' WHEN '' THEN '' ELSE l END AS final_label, CASE src WHEN 'third_pass_resolution' THEN '4' WHEN '' THEN '' ELSE ff END AS final_factor, src AS decision_source, src <> '' AS is_final FROM s""")
def final_decisions(spark, d):
    k = F.col("review_id")
    x = B.human_labels(spark, d).select(F.floor(k / 2).alias("source_uid"), k.alias("row_id"), F.when(k % 13 == 0, "").otherwise(F.col("label")).alias("label"), F.when(k % 5 == 0, "2").otherwise("1").alias("factor"))
    res = x.where(F.col("source_uid") % 2 == 0).select("source_uid", F.lit("uncertain").alias("label"), F.lit("4").alias("factor")).distinct()
    return L.final_decisions(x, res)


TL = ("planet_like", "stellar_variability", "uncertain")


@query("label_transitions", QUEUE, HUMAN_LABELS, LAB, sql=f"""
, t AS (SELECT label AS o, CASE WHEN review_id % 3 = 0 THEN 'uncertain' ELSE label END AS n, stratum, source_kind FROM lb)
{" UNION ALL ".join(f"SELECT {c} AS cohort, {lv} AS level, o AS old_label, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE t.n = '{l}') AS to_{l}" for l in TL) + f" FROM t GROUP BY {g}" for c, lv, g in (("'all'", "''", "o"), ("'stratum'", "stratum", "o, stratum"), ("'source_kind'", "source_kind", "o, source_kind")))}""")
def label_transitions(spark, d):
    q = B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", "label"), "review_id").withColumn("new", F.when(F.col("review_id") % 3 == 0, "uncertain").otherwise(F.col("label")))
    return L.transition_matrix(q, "label", "new", TL, ["stratum", "source_kind"])


@query("revisit_overlay", HUMAN_LABELS, sql="SELECT review_id, CASE WHEN review_id % 5 = 0 AND review_id % 10 <> 0 THEN 'planet_like' ELSE label END AS label, review_id % 5 = 0 AS was_revisited FROM human_labels")
def revisit_overlay(spark, d):
    l = B.human_labels(spark, d)
    k = F.col("review_id")
    return L.overlay(l, l.where(k % 5 == 0).select(k, F.when(k % 10 == 0, "").otherwise("planet_like").alias("label"))).select("review_id", "label", "was_revisited")


@query("label_priority_dedup", LABEL_LOG, sql="""
, s AS (SELECT *, 'log' AS o, 1 AS p FROM label_log UNION ALL SELECT row_id, seq, updated_utc, 'skip', notes, 'old', 0 FROM label_log WHERE seq = 0 UNION ALL SELECT row_id, seq, NULL, 'planet_like', notes, 'expert', 2 FROM label_log WHERE row_id % 9 = 0 AND seq = 0)
SELECT row_id, label, o AS label_origin FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, updated_utc IS NOT NULL DESC, updated_utc DESC, seq DESC) = 1""")
def label_priority_dedup(spark, d):
    l = B.label_log(spark, d)
    old = l.where("seq = 0").withColumn("label", F.lit("skip"))
    exp = l.where("row_id % 9 = 0 AND seq = 0").withColumns({"label": F.lit("planet_like"), "updated_utc": F.lit(None).cast("timestamp_ntz")})
    s = L.stack_sources([("log", 1, l), ("old", 0, old), ("expert", 2, exp)])
    return L.dedupe_by_priority(s, F.col("row_id")).select("row_id", "label", "label_origin")


@query("reanchored_rows", PEAKS, QUEUE, sql="""
, t AS (SELECT * FROM peaks WHERE peak_rank = 1 QUALIFY row_number() OVER (PARTITION BY tic ORDER BY sde DESC, period_d, t0_bjd) = 1)
SELECT q.review_id, round(coalesce(t.period_d, q.period_d), 8) AS period_d, t.tic IS NOT NULL AS is_reanchored FROM queue q LEFT JOIN t ON t.tic = q.tic""")
def reanchored_rows(spark, d):
    return L.reanchor(B.queue(spark, d), B.peaks(spark, d)).select("review_id", r("period_d", 8).alias("period_d"), "is_reanchored")


@query("revisit_variants", QUEUE, sql="SELECT review_id, v AS variant, round(CASE WHEN v = 'half_period' THEN period_d / 2 ELSE period_d END, 8) AS period_d FROM queue, (VALUES ('as_found'), ('half_period')) x(v) WHERE v = 'as_found' OR review_id % 4 = 0")
def revisit_variants(spark, d):
    q = B.queue(spark, d)
    return L.revisit_variants(q, q.where(F.col("review_id") % 4 == 0)).select("review_id", "variant", r("period_d", 8).alias("period_d"))


@query("label_crosstab", QUEUE, HUMAN_LABELS, LAB, sql="SELECT source_bucket, count(*) AS n, count(*) FILTER (WHERE label = 'planet_like') AS planet_like, count(*) FILTER (WHERE label = 'uncertain') AS uncertain FROM lb GROUP BY ALL")
def label_crosstab(spark, d):
    q = B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", "label"), "review_id")
    return L.crosstab(q, "source_bucket", "label", ["planet_like", "uncertain"])


@query("binary_label_targets", HUMAN_LABELS, sql="SELECT review_id, CASE WHEN label = 'eclipsing_binary_or_pceb' THEN 1 ELSE 0 END AS target FROM human_labels WHERE label <> 'skip'")
def binary_label_targets(spark, d):
    return L.binary_targets(B.human_labels(spark, d), ["eclipsing_binary_or_pceb"]).select("review_id", "target")
