"""Queries of the adjudication chain: load, fold, replay, third pass, overlay, queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.operators import adjudication as A
from lumensift.plans.registry import query, r
from lumensift.plans.views import HUMAN_LABELS, LABEL_LOG, QUEUE
from lumensift.sources import binding as B

LOG = """
al AS (SELECT row_id, seq * 2 + row_id % 2 AS seq, updated_utc, CASE WHEN seq % 9 = 8 THEN '' ELSE label END AS label, CASE WHEN row_id % 5 = 0 THEN '?' WHEN seq % 4 = 3 THEN '0.50' ELSE '1.0' END AS button FROM label_log WHERE row_id IS NOT NULL),
am AS (SELECT DISTINCT row_id, 'main:' || CASE WHEN row_id // 2 % 3 = 0 THEN 1000000 + row_id ELSE row_id // 2 END AS u, CASE WHEN row_id // 2 % 3 = 0 THEN 'single' WHEN row_id % 2 = 0 THEN 'original' ELSE 'blind_repeat' END AS o, 0.12::DOUBLE + (row_id * 7 % 1500) / 100 AS p, row_id || '|k' AS k FROM al)"""

#: Newest records per slot and the state they make.
STATES = LOG + """,
af AS (SELECT *, CASE button WHEN '?' THEN 'unresolved' WHEN '0.50' THEN '0.5' ELSE '1' END AS factor FROM al),
ae AS (SELECT u, CASE WHEN o = 'blind_repeat' THEN 'blind_repeat' ELSE 'original' END AS slot, updated_utc AS t, 1 AS pass_no, seq, label, factor FROM af JOIN am USING (row_id)
  UNION ALL SELECT u, 'resolution', updated_utc, 2, seq, CASE WHEN row_id % 14 = 0 THEN '' ELSE 'wide_transit_like' END, '2' FROM af JOIN am USING (row_id) WHERE o = 'original' AND row_id % 4 = 0 AND seq % 3 = 1),
an AS (SELECT u, slot, label, factor FROM ae QUALIFY row_number() OVER (PARTITION BY u, slot ORDER BY t IS NOT NULL DESC, t DESC, pass_no DESC, seq DESC) = 1),
ap AS (SELECT u, max(label) FILTER (slot = 'original') AS a, max(factor) FILTER (slot = 'original') AS fa, max(label) FILTER (slot = 'blind_repeat') AS b, max(factor) FILTER (slot = 'blind_repeat') AS fb, max(label) FILTER (slot = 'resolution') AS c, max(factor) FILTER (slot = 'resolution') AS fc FROM an GROUP BY ALL),
az AS (SELECT u, count(*) AS n_rows, min(p) AS p FROM am GROUP BY ALL),
ev2 AS (SELECT u, count(*) AS n_events FROM ae GROUP BY ALL),
st AS (SELECT az.u, n_rows, p, n_events, a, fa, c, fc, CASE
  WHEN n_rows = 1 THEN CASE WHEN coalesce(a, '') = '' THEN 'unreviewed' ELSE 'single_review' END
  WHEN coalesce(a, '') = '' AND coalesce(b, '') = '' THEN 'unreviewed' WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 'half_reviewed'
  WHEN a = b AND fa = fb THEN 'blind_repeat_agreement' WHEN coalesce(c, '') <> '' THEN 'third_pass_resolution' ELSE 'discordant' END AS state FROM az LEFT JOIN ap ON ap.u = az.u LEFT JOIN ev2 ON ev2.u = az.u),
fd AS (SELECT *, CASE WHEN state = 'third_pass_resolution' THEN c WHEN state IN ('single_review', 'blind_repeat_agreement') THEN a ELSE '' END AS final_label, CASE WHEN state = 'third_pass_resolution' THEN fc WHEN state IN ('single_review', 'blind_repeat_agreement') THEN fa ELSE '' END AS final_factor FROM st)"""

STATUS = "CASE final_factor WHEN '' THEN '' WHEN 'unresolved' THEN 'unresolved' WHEN '1' THEN 'review_period' ELSE 'refolded' END"


def log(spark, d):
    k, s = F.col("row_id"), F.col("seq")
    return B.label_log(spark, d).where("row_id IS NOT NULL").select(
        k, (s * 2 + k % 2).alias("seq"), "updated_utc", F.when(s % 9 == 8, "").otherwise(F.col("label")).alias("label"),
        F.when(k % 5 == 0, "?").when(s % 4 == 3, "0.50").otherwise("1.0").alias("period_factor"))


def manifest(spark, d):
    k = F.col("row_id")
    half = F.floor(k / 2)
    uid = F.concat(F.lit("main:"), F.when(half % 3 == 0, 1000000 + k).otherwise(half).cast("string"))
    occurrence = F.when(half % 3 == 0, "single").when(k % 2 == 0, "original").otherwise("blind_repeat")
    return log(spark, d).select("row_id").distinct().select(k, uid.alias("source_uid"), occurrence.alias("occurrence"), (0.12 + (k * 7 % 1500) / 100).alias("review_period_d"),
                                                            F.concat(k.cast("string"), F.lit("|k")).alias("candidate_key"), uid.alias("repeat_group"))


def events(spark, d):
    l, m = log(spark, d), manifest(spark, d)
    k = F.col("row_id")
    third = l.join(m.where("occurrence = 'original'"), "row_id").where((k % 4 == 0) & (F.col("seq") % 3 == 1)).select(
        "source_uid", "seq", "updated_utc", F.when(k % 14 == 0, "").otherwise("wide_transit_like").alias("label"), F.lit("2").alias("period_factor"))
    return A.events_of(l, m, third)


def decided(spark, d):
    """Folded in two batches, the later events first."""
    e = events(spark, d)
    late = F.coalesce(F.col("seq") % 4 > 1, F.lit(False))
    return A.decisions(manifest(spark, d), A.fold(e.where(~late), A.fold(e.where(late))))


@query("adjudication_reviews", LABEL_LOG, LOG, sql="""
, w AS (SELECT row_id, label, CASE button WHEN '?' THEN 'unresolved' WHEN '0.50' THEN '0.5' ELSE '1' END AS f FROM al QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY updated_utc IS NOT NULL DESC, updated_utc DESC, seq DESC) = 1)
SELECT row_id, u AS source_uid, label, CASE WHEN label = '' THEN '' ELSE f END AS period_factor, CASE WHEN label = '' THEN '' WHEN f = 'unresolved' THEN f WHEN f = '1' THEN 'review_period' ELSE 'refolded' END AS period_status,
  round(CASE WHEN label = '' OR f = 'unresolved' THEN NULL WHEN f = '1' THEN p ELSE p / 2 END, 8) AS period_d FROM w JOIN am USING (row_id)""")
def adjudication_reviews(spark, d):
    m = manifest(spark, d)
    return A.review_load(m.select("row_id", "candidate_key"), log(spark, d), m).select("row_id", "source_uid", "label", "period_factor", "period_status", r("period_d", 8).alias("period_d"))


@query("adjudication_decisions", LABEL_LOG, STATES, sql=f"""
SELECT u AS source_uid, n_rows, n_events, state, state IN ('single_review', 'blind_repeat_agreement', 'third_pass_resolution') AS is_final, final_label, final_factor, {STATUS} AS final_status,
  round(p * TRY_CAST(final_factor AS DOUBLE), 8) AS final_period_d FROM fd""")
def adjudication_decisions(spark, d):
    return decided(spark, d).withColumn("final_period_d", r("final_period_d", 8))


@query("adjudication_replay", LABEL_LOG, STATES, sql="""
, x AS (SELECT ae.*, n_rows, last_value(CASE WHEN slot = 'original' THEN {'l': label, 'f': factor} END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN slot = 'blind_repeat' THEN {'l': label, 'f': factor} END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN slot = 'resolution' THEN {'l': label, 'f': factor} END IGNORE NULLS) OVER w AS c
  FROM ae JOIN az ON az.u = ae.u WINDOW w AS (PARTITION BY ae.u ORDER BY t NULLS FIRST, pass_no, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT u AS source_uid, pass_no, seq, slot, label, CASE WHEN n_rows = 1 THEN CASE WHEN coalesce(a.l, '') = '' THEN 'unreviewed' ELSE 'single_review' END
  WHEN coalesce(a.l, '') = '' AND coalesce(b.l, '') = '' THEN 'unreviewed' WHEN coalesce(a.l, '') = '' OR coalesce(b.l, '') = '' THEN 'half_reviewed'
  WHEN a.l = b.l AND a.f = b.f THEN 'blind_repeat_agreement' WHEN coalesce(c.l, '') <> '' THEN 'third_pass_resolution' ELSE 'discordant' END AS state FROM x""")
def adjudication_replay(spark, d):
    return A.replay(events(spark, d), manifest(spark, d)).drop("at")


@query("resolution_queue", LABEL_LOG, STATES, sql="""
, q AS (SELECT row_number() OVER (ORDER BY u) - 1 AS row_id, am.row_id AS original_row_id, u AS source_uid FROM am WHERE o = 'original' AND u IN (SELECT u FROM st WHERE state = 'discordant'))
SELECT row_id, 'resolution:' || lpad(CAST(row_id AS VARCHAR), CAST(greatest(3, length(CAST(row_id AS VARCHAR))) AS INTEGER), '0') AS review_id, source_uid FROM q""")
def resolution_queue(spark, d):
    public, hidden = A.resolution_queue(manifest(spark, d), decided(spark, d), ["candidate_key"])
    return public.join(hidden.drop("review_id", "repeat_group"), "row_id").select("row_id", "review_id", "source_uid")


@query("adjudicated_table", LABEL_LOG, QUEUE, HUMAN_LABELS, STATES, sql=f"""
, s AS (SELECT 'main:' || q.review_id AS u, label AS label_raw, period_d FROM queue q JOIN human_labels h ON h.review_id = q.review_id UNION ALL
  SELECT 'pilot:' || q.review_id, label, period_d FROM queue q JOIN human_labels h ON h.review_id = q.review_id WHERE q.review_id % 3 = 0),
j AS (SELECT s.*, fd.u IS NOT NULL AS done, final_label, final_factor, state, {STATUS} AS status, p FROM s LEFT JOIN fd ON fd.u = s.u AND fd.final_label <> ''),
k AS (SELECT *, CASE WHEN done THEN final_label ELSE label_raw END AS label FROM j)
SELECT u AS source_uid, label_raw, label, CASE WHEN done THEN state ELSE '' END AS decision_source, round(CASE WHEN done AND status <> 'unresolved' THEN p * TRY_CAST(final_factor AS DOUBLE) ELSE period_d END, 8) AS model_period_d,
  CASE WHEN done AND status <> 'unresolved' THEN 'human_adjudicated_harmonic' ELSE 'current_search' END AS model_ephemeris_source, done AND (final_factor <> '1' OR status = 'unresolved') AS harmonic_suspect,
  TRY_CAST(CASE WHEN done THEN final_factor END AS DOUBLE) AS refold_factor, CASE WHEN done THEN status ELSE '' END AS ephemeris_status, label <> 'skip' AS preserve_include,
  label NOT IN ('skip', 'uncertain') AND NOT (done AND status = 'unresolved' AND label IN ('planet_like', 'eclipsing_binary_or_pceb', 'wide_transit_like', 'stellar_variability')) AS compact_include FROM k""")
def adjudicated_table(spark, d):
    q = B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", "label"), "review_id").select("review_id", "label", "period_d")
    t = A.adjudicated_table({"main": q, "pilot": q.where("review_id % 3 = 0")}, decided(spark, d))
    return t.select("source_uid", "label_raw", "label", "decision_source", r("model_period_d", 8).alias("model_period_d"), "model_ephemeris_source", "harmonic_suspect", "refold_factor", "ephemeris_status",
                    "preserve_include", "compact_include")


SIG = "('planet_like', 'eclipsing_binary_or_pceb', 'wide_transit_like', 'stellar_variability')"
H = lambda c, seed: f"sha256('{seed}|' || {c})"
QUART = lambda v: (f"CASE WHEN {v} IS NULL THEN 'missing' ELSE 'q' || (1 + least(CAST(floor(4 * (row_number() OVER (PARTITION BY origin, label ORDER BY {v} IS NULL, {v}, review_id) - 1) "
                   f"/ count({v}) OVER (PARTITION BY origin, label)) AS BIGINT), 3)) END")


@query("adjudication_queue", QUEUE, HUMAN_LABELS, sql=f"""
, t AS (SELECT q.*, h.label AS first_label, CASE WHEN q.review_id % 7 = 0 THEN 'uncertain' ELSE h.label END AS label, source_bucket AS origin FROM queue q JOIN human_labels h ON h.review_id = q.review_id),
s AS (SELECT 'teacher:' || review_id AS source_uid, tic, 'historical_signal' AS cohort, CASE WHEN first_label IN {SIG} THEN first_label ELSE label END AS historical_label FROM t WHERE first_label IN {SIG} OR label IN {SIG}
  UNION ALL SELECT 'pilot:' || review_id, tic + 100000, 'pilot', label FROM t WHERE review_id % 11 = 0 AND label IN {SIG}),
c AS (SELECT * FROM t WHERE NOT (first_label IN {SIG} OR label IN {SIG}) AND label IN ('uncertain', 'skip') AND tic NOT IN (SELECT tic FROM s)),
z AS (SELECT *, {QUART('period_d')} || '|' || {QUART('tmag')} || '|' || {QUART('sde_max')} AS stratum2 FROM c),
y AS (SELECT *, row_number() OVER (PARTITION BY origin, label, stratum2 ORDER BY {H('review_id', 3)}, review_id) AS rd FROM z),
p AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY origin, label ORDER BY rd, {H('stratum2', 4)}, {H('review_id', 3)}, review_id) <= 5)
SELECT * FROM s UNION ALL SELECT 'teacher:' || review_id, tic, 'control', '' FROM p""")
def adjudication_queue(spark, d):
    t = B.queue(spark, d).join(B.human_labels(spark, d).select("review_id", F.col("label").alias("first")), "review_id")
    now = t.withColumns({"label": F.when(F.col("review_id") % 7 == 0, "uncertain").otherwise(F.col("first")), "origin": F.col("source_bucket")})
    pilot = now.where("review_id % 11 = 0").withColumn("tic", F.col("tic") + 100000)
    q = A.adjudication_queue(t.select("review_id", F.col("first").alias("label")), now.drop("first"), {"pilot": pilot.drop("first")}, ["uncertain", "skip"], 5, 3)
    return q.select("source_uid", "tic", "cohort", "historical_label")
