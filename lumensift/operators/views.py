"""Fixed-size folded, chronological and per-event arrays for model inputs.

Bins are medians per (candidate, aperture, bin), then one array per candidate of a configured length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions import exprs as E
from lumensift.operators import ordered, robust
from lumensift.operators.skew import with_row


def candidate_cadences(candidates: DataFrame, cadences: DataFrame) -> DataFrame:
    """Candidates beside the good cadences of their target (equi join; AQE splits a hot target)."""
    c = cadences.where("quality = 0").select("tic", "aperture", "time", "cadenceno", "flux")
    return candidates.select("review_id", "tic", "period_d", "t0_bjd", "duration_min").join(c, "tic")


def dense(binned: DataFrame, keys: Sequence[str], n: int, value: str = "value", count: str = "n") -> DataFrame:
    """(bin, value, count) rows as arrays: value (0 where empty), mask and count, each of length n."""
    g = binned.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct(value, count)))).alias("m"))
    idx = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    at = lambda i: F.col("m")[i]
    return g.select(*keys, F.transform(idx, lambda i: F.coalesce(at(i)[value], F.lit(0.0)).cast("float")).alias("value"),
                    F.transform(idx, lambda i: at(i)[value].isNotNull().cast("float")).alias("mask"),
                    F.transform(idx, lambda i: F.coalesce(at(i)[count], F.lit(0)).cast("float")).alias("count"))


def folded_bins(joined: DataFrame, n: int, window_durations: float) -> DataFrame:
    """Median flux per phase bin in duration units, relative to the level outside 1.5 durations, for five folds."""
    # dealt by candidate before the rows become five folds, so all medians share one exchange of the rows as they came
    d = joined.select("review_id", "aperture", "time", "flux", "duration_min", "period_d", "t0_bjd").repartition("review_id").withColumn("v", F.explode(E.derived_ephemerides("period_d", "t0_bjd"))).select(
        "review_id", "aperture", "time", "flux", "duration_min", F.col("v.view").alias("view"), F.col("v.period_d").alias("p"), F.col("v.t0_bjd").alias("t"))
    x = E.phase_minutes("time", "p", "t") / F.col("duration_min")
    d = d.withColumn("x", x).where(F.abs("x") < window_durations)
    key = ["review_id", "aperture", "view"]
    base = d.where(F.abs("x") > 1.5).groupBy(*key).agg(F.median("flux").alias("base"))
    b = F.least(F.floor((F.col("x") + window_durations) / F.lit(2 * window_durations / n)), F.lit(n - 1).cast("bigint"))
    g = d.groupBy(*key, b.alias("bin")).agg(F.median("flux").alias("_m"), F.count(F.lit(1)).alias("n"))
    return g.join(base, key, "left").withColumn("value", F.col("_m") / F.nullif("base", F.lit(0.0)) - 1).drop("_m", "base")


def folded_view(joined: DataFrame, n: int = 64, window_durations: float = 4.0) -> DataFrame:
    return dense(folded_bins(joined, n, window_durations).where("value IS NOT NULL"), ["review_id", "aperture", "view"], n)


def timeline_bins(joined: DataFrame, n: int) -> DataFrame:
    """Median relative flux in n equal time bins over each candidate's own baseline."""
    key = ["review_id", "aperture"]
    s = joined.groupBy(*key).agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.median("flux").alias("base"))
    d = joined.join(s, key)
    b = F.least(F.floor((F.col("time") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * n), F.lit(n - 1).cast("bigint"))
    return d.groupBy(*key, b.alias("bin")).agg((F.median("flux") / F.nullif(F.first("base"), F.lit(0.0)) - 1).alias("value"), F.count(F.lit(1)).alias("n"))


def timeline_view(joined: DataFrame, n: int = 128) -> DataFrame:
    return dense(timeline_bins(joined, n), ["review_id", "aperture"], n)


def event_bins(joined: DataFrame, n: int, window_durations: float, max_events: int, min_points: int) -> DataFrame:
    """First events with enough points, each in n bins."""
    d = joined.withColumns({"event": E.event_number("time", "period_d", "t0_bjd"), "x": E.phase_minutes("time", "period_d", "t0_bjd") / F.col("duration_min")})
    d = d.where(F.abs("x") < window_durations)
    key = ["review_id", "aperture"]
    ev = d.groupBy(*key, "event").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_points)
    ev = ev.withColumn("slot", F.row_number().over(W.partitionBy(*key).orderBy("event"))).where(F.col("slot") <= max_events).drop("k")
    b = F.least(F.floor((F.col("x") + window_durations) / F.lit(2 * window_durations / n)), F.lit(n - 1).cast("bigint"))
    return d.join(ev, [*key, "event"]).groupBy(*key, "slot", b.alias("bin")).agg(F.median("flux").alias("value"), F.count(F.lit(1)).alias("n"))


def event_view(joined: DataFrame, n: int = 32, window_durations: float = 4.0, max_events: int = 8, min_points: int = 3) -> DataFrame:
    return dense(event_bins(joined, n, window_durations, max_events, min_points), ["review_id", "aperture", "slot"], n)


def ragged_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], size: int = 4096,
                  hot: bool = False, chunk_d: float = ordered.CHUNK_D) -> DataFrame:
    """All values of each key in order, as rows (key, chunk, start, n_real, mask, one array of ``size`` floats per value).

    Only the last chunk of a key is padded (0, mask 0); a missing value is 0 with its mask in ``mask_<value>`` 0. A long curve is many
    rows, never one array, and other curves do not grow with it. ``hot`` numbers the rows of a curve in chunks of time.
    """
    d = ordered.with_row_index(df, keys, order, "_i", hot, chunk_d)
    d = d.withColumns({"chunk": F.floor(F.col("_i") / size), "_slot": (F.col("_i") % size).cast("int")})
    g = d.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("_slot", *[F.col(v).cast("float").alias(v) for v in values]))).alias("_a"))
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    fill = zeros((F.lit(size) - F.size("_a")).cast("int"))
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    filled = lambda v: lambda s: F.when(known(s[v]), s[v]).otherwise(F.lit(0.0).cast("float"))
    masked = lambda v: lambda s: known(s[v]).cast("float")
    cols = [F.concat(F.transform("_a", filled(v)), fill).alias(v) for v in values]
    masks = [F.concat(F.transform("_a", masked(v)), fill).alias(f"mask_{v}") for v in values]
    return g.select(*keys, "chunk", (F.col("chunk") * size).alias("start"), F.size("_a").alias("n_real"),
                    F.concat(F.array_repeat(F.lit(1.0).cast("float"), F.size("_a")), fill).alias("mask"), *cols, *masks)


def padded(df: DataFrame, keys: Sequence[str], order: Column, value: Column) -> DataFrame:
    """All values of each key in order, zero-padded to the longest key's length, with a mask; no sample is dropped.

    For batches of bounded curves only: one array row holds one model input. Whole tables go through ``ragged_chunks``.
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(value.cast("float").alias("v")).alias("_v")))).alias("s"))
    g = g.withColumn("a", F.transform("s", lambda s: s["_v"]["v"])).drop("s")
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_longest"))
    g = with_row(g, longest)
    pad = F.array_repeat(F.lit(0.0).cast("float"), (F.col("_longest") - F.size("a")).cast("int"))
    mask = F.concat(F.array_repeat(F.lit(1.0).cast("float"), F.size("a")), pad)
    return g.select(*keys, F.concat("a", pad).alias("value"), mask.alias("mask"))


def ragged_lengths(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Real length and number of chunks of each key, beside the longest length (what a batch pads to)."""
    g = chunks.groupBy(*keys).agg(F.sum("n_real").cast("bigint").alias("n_real"), F.count(F.lit(1)).alias("n_chunks"))
    return with_row(g, g.agg(F.max("n_real").alias("longest")))


def ragged_contract(chunks: DataFrame, keys: Sequence[str], values: Sequence[str], size: int) -> DataFrame:
    """Faults of a ragged table, one row: wrong array lengths, gaps in the chunk numbers, padding before the last chunk, masks that miscount."""
    each = [*values, "mask", *[f"mask_{v}" for v in values]]
    wrong = F.lit(False)
    for c in each:
        wrong = wrong | (F.size(c) != size)
    bad_mask = F.aggregate("mask", F.lit(0.0), lambda s, x: s + x) != F.col("n_real")
    rows = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(wrong).alias("n_wrong_length"), F.count_if(bad_mask).alias("n_wrong_mask"))
    per = chunks.groupBy(*keys).agg(F.max("chunk").alias("_hi"), F.min("chunk").alias("_lo"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("n_real") < size).alias("_short"),
                                    F.max_by("n_real", "chunk").alias("_tail"))
    gaps = (F.col("_lo") != 0) | (F.col("_hi") != F.col("_n") - 1)
    early = F.col("_short") > (F.col("_tail") < size).cast("int")
    faults = per.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(gaps).alias("n_with_gaps"), F.count_if(early).alias("n_padded_early"))
    out = rows.transform(with_row, faults)
    bad = ["n_wrong_length", "n_wrong_mask", "n_with_gaps", "n_padded_early"]
    return out.withColumn("passed", (F.col("n_keys") > 0) & (sum(F.col(b) for b in bad) == 0))


def thinned_fold(joined: DataFrame, n_points: int, window_durations: float, apertures: Sequence[str] = ("SML", "PRI"), hot: bool = False) -> DataFrame:
    """Unbinned folds: points in the order of phase, evenly thinned by rank to ``n_points``, with both apertures and their difference.

    One row per kept point: ``slot`` (0-based), ``n_all`` (points before thinning), ``x`` as a fraction of the window, and
    ``value_<aperture>`` relative to the level outside 1.5 durations (all points where none lie there), NULL where the flux is missing.
    """
    key = ["review_id", "view"]
    # dealt by candidate once: apertures are paired before the rows become five folds, and no later step moves them
    d = joined.select("review_id", "aperture", "time", "cadenceno", "flux", "duration_min", "period_d", "t0_bjd").repartition("review_id").groupBy("review_id", "time", "cadenceno").agg(
        F.first("period_d").alias("period_d"), F.first("t0_bjd").alias("t0_bjd"), F.first("duration_min").alias("_d"),
        *[F.max(F.when((F.col("aperture") == a) & ~F.isnan(F.col("flux").cast("double")), F.col("flux"))).alias(f"_f{i}") for i, a in enumerate(apertures)])
    d = d.withColumn("v", F.explode(E.derived_ephemerides("period_d", "t0_bjd"))).select("*", F.col("v.view").alias("view"), F.col("v.period_d").alias("_p"), F.col("v.t0_bjd").alias("_t")).drop("v", "period_d", "t0_bjd")
    d = d.withColumn("_x", E.phase_minutes("time", "_p", "_t") / F.nullif("_d", F.lit(0.0))).where(F.abs("_x") <= window_durations)
    outer = [F.when(F.abs("_x") > 1.5, F.col(f"_f{i}")) for i in range(len(apertures))]
    level = {"n_all": F.count(F.lit(1)), **{f"_o{i}": F.median(o) for i, o in enumerate(outer)}, **{f"_a{i}": F.median(f"_f{i}") for i in range(len(apertures))}}
    d = robust.with_agg(ordered.with_row_index(d, key, ["_x", "time", "cadenceno"], "_r", hot, window_durations / 64), key, hot, **level)
    d = d.withColumns({f"_b{i}": F.coalesce(f"_o{i}", f"_a{i}") for i in range(len(apertures))})
    step = (F.col("n_all") - 1) / F.lit(float(n_points - 1))
    near = F.rint(F.col("_r") / step).cast("bigint")
    hits = lambda k: (k >= 0) & (k < n_points) & (F.when(k == n_points - 1, F.col("n_all") - 1).otherwise(F.rint(k * step).cast("bigint")) == F.col("_r"))
    slot = F.filter(F.array(near - 1, near, near + 1), hits)
    d = d.withColumn("slot", F.when(F.col("n_all") <= n_points, F.col("_r")).otherwise(F.try_element_at(slot, F.lit(1)))).where("slot IS NOT NULL")
    vals = [(F.col(f"_f{i}") / F.nullif(f"_b{i}", F.lit(0.0)) - 1).alias(f"value_{a.lower()}") for i, a in enumerate(apertures)]
    out = d.select(*key, "slot", "n_all", (F.col("_x") / window_durations).alias("x"), *vals)
    return out if len(apertures) < 2 else out.withColumn("value_difference", F.col(f"value_{apertures[1].lower()}") - F.col(f"value_{apertures[0].lower()}"))


def harmonic_windows(joined: DataFrame, factors: Sequence[float], cadence_min: float = 3.34) -> DataFrame:
    """Rows inside the local primary and secondary windows of each harmonic fold."""
    d = joined.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    p = F.col("period_d") * F.col("factor")
    half = F.least(F.greatest(4.0 * F.col("duration_min"), F.lit(3 * cadence_min)), 0.2 * p * 1440.0)
    prim = E.phase_minutes("time", p, "t0_bjd")
    sec = E.phase_minutes("time", p, F.col("t0_bjd") + p / 2)
    d = d.withColumns({"window": F.when(F.abs(prim) <= half, "primary").when(F.abs(sec) <= half, "secondary"), "phase_min": F.when(F.abs(prim) <= half, prim).otherwise(sec)})
    return d.where("window IS NOT NULL")


def shape_columns(binned: DataFrame, n: int) -> DataFrame:
    """Folded bins as flat columns ``shape_<aperture>_<bin>`` per candidate."""
    d = binned.where("view = 'model'")
    aggs = [F.max(F.when((F.lower("aperture") == a) & (F.col("bin") == i), F.col("value"))).alias(f"shape_{a}_{i}") for a in ("sml", "pri") for i in range(n)]
    return d.groupBy("review_id").agg(*aggs)
