"""Queries of scalar rules, smoothing curves, refinement and the streaming twins."""

from __future__ import annotations

from dataclasses import replace
import uuid

from pyspark.sql import functions as F

from lumensift.functions import exprs as E, sql as Q
from lumensift.operators import ordered, robust, search as S
from lumensift.operators.ordering import shared_folder, with_global_row_number
from lumensift.plans.cadence_queries import CLIP, curves
from lumensift.plans.registry import query, r
from lumensift.plans.search_queries import CFG, PH, prepared
from lumensift.plans.views import CADENCES, CATALOG, INJECTIONS, LABEL_LOG, PEAKS, QUEUE
from lumensift.sources import binding as B
from lumensift.streaming import streams as T


@query("fold_window_sizing", PEAKS, sql="""
, w AS (SELECT *, CASE WHEN duration_min > 0 THEN least(greatest(18, 4 * duration_min), 60) ELSE 45 END AS w FROM peaks)
SELECT tic, peak_rank, uid_a, uid_b, CAST(w AS DOUBLE) AS window_min, least(greatest(CAST(ceil(2 * w / greatest(1, least(3, duration_min / 3))) AS BIGINT), 18), 72) AS n_bins, round(least(greatest(w / (period_d * 1440), 0.0015), 0.25), 9) AS window_phase FROM w""")
def fold_window_sizing(spark, d):
    return B.peaks(spark, d).select("tic", "peak_rank", "uid_a", "uid_b", E.fold_window_min("duration_min").alias("window_min"), E.fold_bin_count(E.fold_window_min("duration_min"), "duration_min").alias("n_bins"),
                                    r(E.fold_window_phase("period_d", "duration_min"), 9).alias("window_phase"))


@query("epoch_distances", PEAKS, INJECTIONS, sql=f"""
SELECT p.injection_id, peak_rank, uid_a, uid_b, round(abs({PH('t0_bjd', 'truth_period_d', 'truth_t0_bjd')}) * 1440, 3) AS epoch_offset_min, CAST(round_even((t0_bjd - truth_t0_bjd) / truth_period_d, 0) AS BIGINT) AS event,
  round(abs({PH('t0_bjd', 'period_d', 'truth_t0_bjd')} / period_d), 8) AS circular FROM peaks p JOIN injections i ON i.injection_id = p.injection_id""")
def epoch_distances(spark, d):
    j = B.peaks(spark, d).join(B.injections(spark, d).drop("tic", "tmag"), "injection_id")
    ph = E.orbital_phase("t0_bjd", "period_d", "truth_t0_bjd")
    return j.select("injection_id", "peak_rank", "uid_a", "uid_b", r(E.epoch_offset_min("t0_bjd", "truth_t0_bjd", "truth_period_d"), 3).alias("epoch_offset_min"),
                    E.event_number("t0_bjd", "truth_period_d", "truth_t0_bjd").alias("event"), r(E.circular_distance(ph, F.lit(0.0)), 8).alias("circular"))


@query("event_time_lists", QUEUE, sql="""
, k AS (SELECT review_id, period_d AS p, t0_bjd - 2457000 AS t0, CAST(ceil((5.0 - (t0_bjd - 2457000)) / period_d) AS BIGINT) AS a, CAST(floor((32.0 - (t0_bjd - 2457000)) / period_d) AS BIGINT) AS b FROM queue)
SELECT review_id, greatest(0, b - a + 1) AS n_events, CASE WHEN b >= a THEN round(t0 + a * p, 6) END AS first_event FROM k""")
def event_time_lists(spark, d):
    q = B.queue(spark, d).withColumn("e", E.event_times(F.lit(5.0), F.lit(32.0), "period_d", F.col("t0_bjd") - 2457000))
    return q.select("review_id", F.size("e").cast("bigint").alias("n_events"), r(F.try_element_at("e", F.lit(1))).alias("first_event"))


@query("circle_overlap_depths", INJECTIONS, sql="""
, g AS (SELECT injection_id, radius_rearth / 5 AS r, (injection_id % 97) / 40 AS d FROM injections)
SELECT injection_id, round(CASE WHEN d >= 1 + r THEN 0 WHEN d <= abs(1 - r) THEN least(r * r, 1) ELSE (acos(greatest(-1, least(1, (d * d + 1 - r * r) / (2 * d)))) + r * r * acos(greatest(-1, least(1, (d * d + r * r - 1) / (2 * d * r)))) - 0.5 * sqrt(greatest(0, (-d + 1 + r) * (d + 1 - r) * (d - 1 + r) * (d + 1 + r)))) / pi() END, 7) AS depth FROM g""")
def circle_overlap_depths(spark, d):
    return B.injections(spark, d).select("injection_id", r(E.circle_overlap(F.col("radius_rearth") / 5, (F.col("injection_id") % 97) / 40), 7).alias("depth"))


OVL = lambda r, x: (f"CASE WHEN {x} >= 1 + {r} THEN 0 WHEN {x} <= abs(1 - {r}) THEN least({r} * {r}, 1) ELSE (acos(greatest(-1, least(1, ({x} * {x} + 1 - {r} * {r}) / (2 * {x})))) + {r} * {r} * acos(greatest(-1, least(1, ({x} * {x} + {r} * {r} - 1) / (2 * {x} * {r}))))"
                    f" - 0.5 * sqrt(greatest(0, (-{x} + 1 + {r}) * ({x} + 1 - {r}) * ({x} - 1 + {r}) * ({x} + 1 + {r})))) / pi() END")


@query("impact_for_depth", "RECURSIVE " + INJECTIONS.strip(), f"""
z(injection_id, r, want, lo, hi, k) AS (SELECT injection_id, radius_rearth / 11, model_depth, 0.0::DOUBLE, 1 + radius_rearth / 11, 0 FROM injections
  UNION ALL SELECT injection_id, r, want, CASE WHEN {OVL('r', '((lo + hi) / 2)')} > want THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {OVL('r', '((lo + hi) / 2)')} > want THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM z WHERE k < 64)""", sql="""
SELECT injection_id, round(CASE WHEN want >= least(r * r, 1) THEN 0 WHEN want <= 0 THEN 1 + r ELSE (lo + hi) / 2 END, 7) AS impact FROM z WHERE k = 64""")
def impact_for_depth(spark, d):
    i = B.injections(spark, d)
    return i.select("injection_id", r(E.impact_for_depth(F.col("radius_rearth") / 11, F.col("model_depth")), 7).alias("impact"))


@query("note_period_factors", LABEL_LOG, sql="""
SELECT row_id, seq, CASE notes WHEN 'p/2' THEN 0.5::DOUBLE WHEN '2.5 p maybe' THEN 2.5::DOUBLE END AS note_factor, CASE notes WHEN 'p/2' THEN 'p_over_2' ELSE '' END AS harmonic, CASE notes WHEN 'p/2' THEN 0.5::DOUBLE END AS supported FROM label_log""")
def note_period_factors(spark, d):
    l = B.label_log(spark, d).withColumn("note_factor", E.note_period_factor("notes"))
    return l.select("row_id", "seq", "note_factor", F.coalesce(E.harmonic_name("note_factor"), F.lit("")).alias("harmonic"), E.nearest_supported_factor("note_factor").alias("supported"))


BUTTONS = ("0.250", "0.50", "1.0", "", "2", "?", "4.0")


@query("button_period_factors", LABEL_LOG, sql="""
, b AS (SELECT row_id, seq, CASE (row_id + seq) % 7 WHEN 0 THEN '0.25' WHEN 1 THEN '0.5' WHEN 2 THEN '1' WHEN 3 THEN '1' WHEN 4 THEN '2' WHEN 5 THEN 'unresolved' ELSE '4' END AS t FROM label_log)
SELECT row_id, seq, t AS factor_text, CASE t WHEN 'unresolved' THEN 'unresolved' WHEN '1' THEN 'review_period' ELSE 'refolded' END AS status, CASE WHEN t <> 'unresolved' THEN TRY_CAST(t AS DOUBLE) END AS factor FROM b""")
def button_period_factors(spark, d):
    k = (F.col("row_id") + F.col("seq")) % 7
    text = F.element_at(F.array(*[F.lit(b) for b in BUTTONS]), k.cast("int") + 1)
    return B.label_log(spark, d).select("row_id", "seq", E.button_factor(text).alias("b")).select("row_id", "seq", "b.*")


@query("ephemeris_precedence", QUEUE, sql="""
SELECT review_id, CASE WHEN review_id % 4 = 0 AND review_id % 3 <> 0 THEN 'model' WHEN review_id % 5 = 0 THEN 'display' ELSE 'queue' END AS source,
  round(CASE WHEN review_id % 4 = 0 AND review_id % 3 <> 0 THEN period_d * 2 WHEN review_id % 5 = 0 THEN period_d / 2 ELSE period_d END, 8) AS period_d FROM queue""")
def ephemeris_precedence(spark, d):
    k = F.col("review_id")
    q = B.queue(spark, d).withColumns({"mp": F.when(k % 4 == 0, F.col("period_d") * 2), "md": F.when(k % 3 != 0, F.col("duration_min")).otherwise(0.0), "dp": F.when(k % 5 == 0, F.col("period_d") / 2)})
    e = E.first_ephemeris(("mp", "t0_bjd", "md", "model"), ("dp", "t0_bjd", "duration_min", "display"), ("period_d", "t0_bjd", "duration_min", "queue"))
    return q.select("review_id", e.alias("e")).select("review_id", "e.source", r("e.period_d", 8).alias("period_d"))


@query("cadence_alias_flags", PEAKS, sql="SELECT aperture, count(*) FILTER (WHERE abs(period_d / 0.5::DOUBLE - round_even(period_d / 0.5::DOUBLE, 0)) <= 0.02::DOUBLE) AS n_alias, count(*) AS n FROM peaks GROUP BY ALL")
def cadence_alias_flags(spark, d):
    return B.peaks(spark, d).groupBy("aperture").agg(F.count_if(E.cadence_alias("period_d", 0.5)).alias("n_alias"), F.count(F.lit(1)).alias("n"))


@query("designation_ids", sql="SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey * 1000003 END AS source_id, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_custkey * 1000003 END AS source_id_or_sentinel FROM customer")
def designation_ids(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("Gaia DR3 "), F.when(k % 7 == 0, "n/a").otherwise((k * 1000003).cast("string")))
    i = E.last_token_id(text)
    return B.table(spark, d, "customer").select(k, i.alias("source_id"), F.coalesce(i, F.lit(-1).cast("bigint")).alias("source_id_or_sentinel"))


@query("ulp_equality", PEAKS, sql="SELECT aperture, count(*) FILTER (WHERE uid_a % 3 <> 1) AS n_equal, count(*) AS n FROM peaks GROUP BY ALL")
def ulp_equality(spark, d):
    p = F.col("period_d")
    other = F.when(F.col("uid_a") % 3 == 0, p * (1 + 2.220446049250313e-16)).when(F.col("uid_a") % 3 == 1, p * (1 + 1e-12)).otherwise(p)
    return B.peaks(spark, d).groupBy("aperture").agg(F.count_if(E.ulp_equal(p, other)).alias("n_equal"), F.count(F.lit(1)).alias("n"))


@query("status_levels", CATALOG, sql="""
, s AS (SELECT source_id, CASE WHEN ruwe <= 1.0::DOUBLE THEN 'pass' WHEN ruwe <= 1.4::DOUBLE THEN 'review' ELSE 'fail' END AS a, CASE WHEN parallax IS NULL THEN 'fail' WHEN parallax >= 0.5 THEN 'pass' WHEN parallax >= 0 THEN 'review' ELSE 'fail' END AS b,
  CASE WHEN pwd BETWEEN 0.4::DOUBLE AND 0.8::DOUBLE THEN 'pass' WHEN pwd BETWEEN 0.2::DOUBLE AND 0.9::DOUBLE THEN 'review' ELSE 'fail' END AS c FROM catalog)
SELECT *, CASE WHEN 'fail' IN (a, b, c) THEN 'fail' WHEN 'review' IN (a, b, c) THEN 'review' ELSE 'pass' END AS worst FROM s""")
def status_levels(spark, d):
    s = B.catalog(spark, d).select("source_id", E.status_max("ruwe", 1.0, 1.4).alias("a"), E.status_min("parallax", 0.5, 0.0).alias("b"), E.status_interval("pwd", 0.4, 0.8, 0.2, 0.9).alias("c"))
    return s.withColumn("worst", E.worst_status("a", "b", "c"))


ANCHORS = ((0.2, 4.0), (1.0, 5.5), (4.0, 1.6), (11.0, 1.3), (18.0, 20.0))
LA = [(f"ln({a}::DOUBLE)", f"ln({b}::DOUBLE)") for a, b in ANCHORS]
DENS = "exp(CASE WHEN ln(radius_rearth) <= " + LA[0][0] + " THEN " + LA[0][1] + " " + " ".join(
    f"WHEN ln(radius_rearth) <= {x1} THEN {y0} + (ln(radius_rearth) - {x0}) * ({y1} - {y0}) / ({x1} - {x0})" for (x0, y0), (x1, y1) in zip(LA, LA[1:])) + f" ELSE {LA[-1][1]} END)"


@query("reference_curves", INJECTIONS, sql=f"""
SELECT injection_id, round({DENS}, 7) AS density, round(sqrt(3 * pi() * pow(2.44::DOUBLE, 3) / 6.67430e-11 / ({DENS} * 1000)) / 86400, 7) AS roche_d, round(pow(10, (ln(0.5::DOUBLE / 0.5::DOUBLE) - 12 + 0.6::DOUBLE * tmag) / 3.0::DOUBLE), 6) AS boundary_radius FROM injections""")
def reference_curves(spark, d):
    dens = E.log_interp("radius_rearth", ANCHORS)
    return B.injections(spark, d).select("injection_id", r(dens, 7).alias("density"), r(E.fluid_roche_period_d(dens), 7).alias("roche_d"), r(E.boundary_radius(12.0, 3.0, -0.6, "tmag", 0.5)).alias("boundary_radius"))


@query("propagated_errors", INJECTIONS, sql="SELECT injection_id, round(1.5e4 * pow(10, (10 - tmag) / 2.5), 6) AS rate, round(sqrt(greatest(4.0 - 1.5e4 * pow(10, (10 - tmag) / 2.5) / 200, 0) + (1 - model_depth) * (1.5e4 * pow(10, (10 - tmag) / 2.5) / 200)), 8) AS err FROM injections")
def propagated_errors(spark, d):
    rate = E.count_rate("tmag")
    return B.injections(spark, d).select("injection_id", r(rate).alias("rate"), r(E.propagated_error(F.lit(2.0), rate, 1 - F.col("model_depth")), 8).alias("err"))


@query("class_indices", PEAKS, sql="SELECT aperture, CASE WHEN aperture = 'PRI' THEN 0 ELSE -1 END AS idx_known, CASE WHEN peak_rank % 2 = 0 THEN CASE aperture WHEN 'PRI' THEN 0 ELSE 1 END ELSE -1 END AS idx_masked, count(*) AS n FROM peaks GROUP BY ALL")
def class_indices(spark, d):
    p = B.peaks(spark, d)
    return p.groupBy("aperture", E.class_index("aperture", ["PRI"]).cast("int").alias("idx_known"), E.class_index("aperture", ["PRI", "SML"], F.col("peak_rank") % 2 == 0).cast("int").alias("idx_masked")).agg(F.count(F.lit(1)).alias("n"))


@query("magnitude_running_median", PEAKS, sql="""
, b AS (SELECT CAST(floor((tmag - 16) / 0.25::DOUBLE) AS BIGINT) AS bin, median(depth_snr) AS m, count(*) AS n FROM peaks GROUP BY ALL HAVING count(*) >= 5)
SELECT bin, n, round(m, 7) AS median_value, round(median(m) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 7) AS smooth FROM b""")
def magnitude_running_median(spark, d):
    b = B.peaks(spark, d).groupBy(F.floor((F.col("tmag") - 16) / 0.25).alias("bin")).agg(F.percentile("depth_snr", 0.5).alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 5").withColumn("one", F.lit(1))
    s = ordered.with_running_median(b, ["one"], ["bin"], F.col("m"), "smooth", 2)
    return s.select("bin", "n", r("m", 7).alias("median_value"), r("smooth", 7).alias("smooth"))


@query("refined_ephemerides")
def refined_ephemerides(spark, d):
    """Narrow linear grid around each curve's best period."""
    _, q, st, hot = prepared(spark, d)
    one = replace(CFG, n_peaks=1)
    if not hot:
        curves = S.packed_curves(q, CFG)
        return S.refine_packed(curves, S.pick_peaks(S.with_sde(S.fold_packed(curves, CFG)), one), 0.01, 101, CFG)
    return S.refine(q, st, S.pick_peaks(S.with_sde(S.spectrum(q, st, CFG, hot)), one), 0.01, 101, CFG)


@query("search_parameter_sweep")
def search_parameter_sweep(spark, d):
    c, hot = curves(spark, d)
    base = replace(CFG, n_periods=100)
    return S.parameter_sweep(c, {"base": base, "long": replace(base, durations_min=(360.0, 600.0))}, hot).groupBy("sweep", "status", "peak_rank").agg(F.count(F.lit(1)).alias("n"), F.percentile("sde", 0.5).alias("median_sde"))


@query("truth_signal_diagnostics", CADENCES, CLIP, INJECTIONS, sql=f"""
, t AS (SELECT injection_id, tic, truth_period_d AS p, truth_t0_bjd - 2457000 AS t0, truth_duration_min * 10 AS du FROM injections),
j AS (SELECT injection_id, aperture, y, abs({PH('time', 'p', 't0')}) * 1440 AS m, du FROM clean c JOIN t ON t.tic = c.tic), k AS (SELECT injection_id, aperture, CASE WHEN m <= du / 2 THEN y END AS i, CASE WHEN m > greatest(5 * du, du + 20) THEN y END AS o FROM j),
z AS (SELECT *, median(o) OVER (PARTITION BY injection_id, aperture) AS mo FROM k)
SELECT injection_id, aperture, count(i) AS n_in, count(o) AS n_out, round(1 - median(i) / any_value(mo), 7) AS depth FROM z GROUP BY ALL""")
def truth_signal_diagnostics(spark, d):
    from lumensift.operators import cadence as C
    from lumensift.plans.cadence_queries import MIN_ROWS
    c, hot = curves(spark, d)
    t = B.injections(spark, d).select("injection_id", "tic", "truth_period_d", (F.col("truth_t0_bjd") - 2457000).alias("truth_t0"), (F.col("truth_duration_min") * 10).alias("truth_duration_min"))
    g = S.truth_diagnostics(C.clean(c, MIN_ROWS, hot=hot), t, ["injection_id", "aperture"], hot)
    return g.select("injection_id", "aperture", "n_in", "n_out", r("depth", 7).alias("depth"))


@query("sql_functions_on_cadences", CADENCES, sql=f"""
SELECT orbitid, aperture, count(*) FILTER (WHERE abs({PH('time', '1.7::DOUBLE', '0.4::DOUBLE')}) < 0.1) AS n_near, CAST(min(round_even((time - 0.4::DOUBLE) / 1.7::DOUBLE, 0)) AS BIGINT) AS first_event, CAST(max(round_even((time - 0.4::DOUBLE) / 1.7::DOUBLE, 0)) AS BIGINT) AS last_event FROM cadences GROUP BY ALL""")
def sql_functions_on_cadences(spark, d):
    Q.register(spark)
    return spark.sql("""SELECT orbitid, aperture, count_if(abs(phase_days(time, 1.7D, 0.4D)) < 0.1D) AS n_near, min(event_number(time, 1.7D, 0.4D)) AS first_event, max(event_number(time, 1.7D, 0.4D)) AS last_event
                        FROM {c} GROUP BY orbitid, aperture""", c=B.cadences(spark, d))


def _drain(stream, mode: str):
    """Run a bounded file stream to its end; its batches are files, a folder per epoch, in the shared checkpoint folder."""
    target = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).foreachBatch(T.merge_latest(f"{target}/out")).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = stream.sparkSession.read.parquet(f"{target}/out")
    return T.as_of(out) if mode == "update" else T.last_epoch(out)


def _stream(spark, d, name: str):
    """A table as a stream. A stream wants a folder or a pattern: the pattern finds a table that is one file, and all files of one that is a folder."""
    return spark.readStream.schema(B.table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("stream_latest_labels", LABEL_LOG, sql="SELECT row_id, seq, label FROM label_log QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY updated_utc DESC NULLS LAST, seq DESC) = 1")
def stream_latest_labels(spark, d):
    c = _stream(spark, d, "conversations")
    stamp = F.when(F.col("turn") % 5 != 4, F.expr("timestampadd(MINUTE, cast(turn * 7 % 5 as int), TIMESTAMP'2024-03-01 00:00:00')"))
    label = F.when(F.col("role") == "user", "planet_like").when(F.col("role") == "assistant", "uncertain").otherwise("skip")
    log = c.select(F.col("conv_id").alias("row_id"), label.alias("label"), stamp.alias("updated_utc"), F.col("turn").alias("seq"))
    return _drain(T.latest_label_stream(log, ttl_ms=None), "update").select("row_id", "seq", "label")


def _events(spark, d):
    return _stream(spark, d, "events").select(F.col("user_id").alias("tic"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("flux"), "event_id")


@query("stream_gap_sessions", sql="""
WITH l AS (SELECT user_id AS tic, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pt FROM events), s AS (SELECT tic, ts, sum(CASE WHEN pt IS NULL OR ts - pt >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY tic ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT tic, date_diff('microsecond', TIMESTAMP '2024-01-01', min(ts)) AS start_us, count(*) AS n FROM s GROUP BY tic, k""")
def stream_gap_sessions(spark, d):
    t = _drain(T.gap_session_stream(_events(spark, d)), "complete")
    return t.select("tic", F.expr("timestampdiff(MICROSECOND, TIMESTAMP'2024-01-01 00:00:00', t_start)").alias("start_us"), "n")


@query("stream_noise_bins", sql="SELECT user_id AS tic, date_diff('microsecond', TIMESTAMP '2024-01-01', time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS start_us, quantile_disc(value, 0.5) AS median_flux, count(*) AS n FROM events GROUP BY 1, 2")
def stream_noise_bins(spark, d):
    t = _drain(T.noise_bin_stream(_events(spark, d), "6 hours"), "complete")
    return t.select("tic", F.expr("timestampdiff(MICROSECOND, TIMESTAMP'2024-01-01 00:00:00', t_start)").alias("start_us"), "median_flux", "n")


@query("stream_arrivals", sql="""
WITH e AS (SELECT user_id % 5 AS sector, user_id % 3 AS orbit, count(DISTINCT user_id) + 2 AS n FROM events GROUP BY ALL) SELECT user_id % 5 AS sector, user_id % 3 AS orbit, any_value(e.n) AS n_expected, count(DISTINCT user_id) AS n_arrived FROM events JOIN e ON e.sector = user_id % 5 AND e.orbit = user_id % 3 GROUP BY ALL""")
def stream_arrivals(spark, d):
    u = F.col("tic")
    a = _events(spark, d).select(u, (u % 5).alias("sector"), (u % 3).alias("orbit"))
    ev = B.table(spark, d, "events").select(F.col("user_id").alias("tic")).distinct().select(u, (u % 5).alias("sector"), (u % 3).alias("orbit"))
    extra = ev.select("sector", "orbit").distinct().select(F.explode(F.array(F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint"))).alias("tic"), "sector", "orbit")
    return T.against_expected(_drain(T.arrival_stream(a), "complete"), ev.unionByName(extra))


@query("adaptive_running_median", PEAKS, sql="""
, w AS (SELECT tic, peak_rank, uid_a, uid_b, tmag, depth_snr, CASE WHEN tmag <= 17.0 THEN 21.0::DOUBLE WHEN tmag >= 20.0 THEN 5.0::DOUBLE ELSE 21 + (tmag - 17.0::DOUBLE) * (-16 / 3.0::DOUBLE) END AS s, row_number() OVER (ORDER BY tmag, tic, peak_rank, uid_a, uid_b, depth_snr) AS rn FROM peaks),
h AS (SELECT *, greatest(CAST(floor(greatest(round_even(s, 0), 1) / 2) AS BIGINT), 1) AS half FROM w)
SELECT tic, peak_rank, uid_a, uid_b, round(median(depth_snr) OVER (ORDER BY rn ROWS BETWEEN half PRECEDING AND half FOLLOWING), 7) AS smooth FROM h""")
def adaptive_running_median(spark, d):
    """Median of neighbours in magnitude over all peaks at once; bright stars have the wider frame."""
    key = ["tic", "peak_rank", "uid_a", "uid_b"]
    p = B.peaks(spark, d).select(*key, F.col("tmag").cast("double").alias("tmag"), "depth_snr", F.struct(*key, "depth_snr").alias("tie"))
    return ordered.with_adaptive_median(p, "tmag", "depth_snr", "tie", (17.0, 21), (20.0, 5)).select(*key, r("smooth", 7).alias("smooth"))
