"""Recovery accounting: injection outcomes, grids, boundaries, surfaces and comparisons.

Everything reduces to partial aggregates keyed by injection or grid cell; grids themselves come from
``sequence`` + ``explode`` of bounded size, never from joining a table with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions import exprs as E
from lumensift.operators import robust
from lumensift.operators.ordering import cut_lineage
from lumensift.operators.skew import with_row

TRUTH_COLS = ("truth_period_d", "truth_tmag", "grid_period_bin", "grid_radius_bin", "n_good_in_transit", "model_depth")


def injection_outcomes(labelled: DataFrame, top_k: int = 5, truth: Sequence[str] = TRUTH_COLS) -> DataFrame:
    """One row per injection: matches at 1 and K, kinds, best signal rank, ranking loss, truth columns."""
    sig, rank = F.col("is_signal"), F.col("peak_rank")
    g = labelled.groupBy("injection_id").agg(
        F.bool_or(sig & (rank == 1)).alias("top1"), F.bool_or(sig & (rank <= top_k)).alias("topk"),
        F.bool_or((F.col("match_kind") == "exact") & (rank <= top_k)).alias("exact_topk"),
        F.bool_or((F.col("match_kind") == "harmonic") & (rank <= top_k)).alias("harmonic_topk"),
        F.min(F.when(sig, rank)).alias("best_signal_rank"), F.count(F.lit(1)).alias("n_peaks"),
        *[F.first(c, ignorenulls=True).alias(c) for c in truth])
    return g.withColumn("ranking_loss", F.col("topk") & ~F.col("top1"))


def fraction(n: Column, total: Column) -> Column:
    return n / F.nullif(total, F.lit(0))


def cell_grid(outcomes: DataFrame, cells: Sequence[str], min_count: int = 20, threshold: float = 0.5) -> DataFrame:
    """Counts and fractions per cell with a support gate."""
    g = outcomes.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), F.count_if("top1").alias("n_top1"), F.count_if("topk").alias("n_topk"))
    frac = fraction(F.col("n_topk"), F.col("n"))
    return g.withColumns({
        "top1_fraction": fraction(F.col("n_top1"), F.col("n")), "topk_fraction": frac,
        "gate": F.when(F.col("n") < min_count, "low_support").when(frac >= threshold, "recoverable").otherwise("limited")})


def global_summary(outcomes: DataFrame, min_topk: float = 0.2, min_loss: float = 0.05) -> DataFrame:
    """Overall counts with a recommendation on whether a ranker is worth training."""
    g = outcomes.agg(F.count(F.lit(1)).alias("n"), F.count_if("top1").alias("n_top1"), F.count_if("topk").alias("n_topk"), F.count_if("ranking_loss").alias("n_loss"))
    topk, loss = fraction(F.col("n_topk"), F.col("n")), fraction(F.col("n_loss"), F.col("n"))
    return g.withColumns({"topk_fraction": topk, "loss_fraction": loss,
                          "recommendation": F.when(topk < min_topk, "improve_search").when(loss >= min_loss, "train_ranker").otherwise("keep_rank")})


def annotate_with_cells(outcomes: DataFrame, grid: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Cell metrics back on the injections; the grid is small, AQE broadcasts it when it fits."""
    return outcomes.join(grid.select(*cells, F.col("topk_fraction").alias("cell_fraction"), "gate"), list(cells), "left")


def failure_modes(outcomes: DataFrame, q: float = 0.5, min_reference: int = 5) -> DataFrame:
    """Why an injection was missed: weak for its brightness, mis-ranked, or missed though observable.

    Reference strength per brightness bin is a quantile over recovered rows, global where a bin is thin.
    """
    d = outcomes.withColumns({"tmag_bin": E.tmag_bin("truth_tmag"), "proxy": F.abs("model_depth") * F.sqrt(F.col("n_good_in_transit").cast("double"))})
    rec = d.where("topk")
    ref = rec.groupBy("tmag_bin").agg(F.percentile("proxy", q).alias("bin_ref"), F.count(F.lit(1)).alias("n_ref"))
    whole = rec.agg(F.percentile("proxy", q).alias("all_ref"))
    d = d.join(ref, "tmag_bin", "left").transform(with_row, whole)
    limit = F.when(F.col("n_ref") >= min_reference, F.col("bin_ref")).otherwise(F.col("all_ref"))
    mode = (F.when(F.col("top1"), "recovered_top1").when(F.col("topk"), "recovered_topk")
            .when(F.col("best_signal_rank").isNotNull(), "ranked_too_deep")
            .when(F.col("proxy") >= limit, "observable_missed").otherwise("weak_signal"))
    return d.withColumns({"reference": limit, "failure_mode": mode}).drop("bin_ref", "all_ref", "n_ref")


def failure_grid(modes: DataFrame, cells: Sequence[str]) -> DataFrame:
    return modes.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("failure_mode") == "observable_missed").alias("n_observable_missed"),
        F.count_if(F.col("failure_mode") == "ranked_too_deep").alias("n_deep"), F.median("proxy").alias("median_proxy"))


def marginals(df: DataFrame, axes: Sequence[str], recovered: str) -> DataFrame:
    """Recovered counts along every axis in one pass: GROUPING SETS over the axes."""
    df = df.select(*axes, recovered)
    sets = [[F.col(a)] for a in axes]
    g = df.groupingSets(sets, *[F.col(a) for a in axes]).agg(
        F.grouping_id(*axes).alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if(recovered).alias("n_recovered"))
    full = (1 << len(axes)) - 1
    axis, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, a in enumerate(axes):
        here = F.col("_g") == full - (1 << (len(axes) - 1 - i))
        axis, level = F.when(here, a).otherwise(axis), F.when(here, F.col(a).cast("string")).otherwise(level)
    return g.select(axis.alias("axis"), level.alias("level"), "n", "n_recovered", fraction(F.col("n_recovered"), F.col("n")).alias("fraction"))


def grid_fraction(df: DataFrame, x: Column, y: Column, x_edges: Sequence[float], y_edges: Sequence[float], recovered: str, min_count: int = 1) -> DataFrame:
    """Recovered share per 2-D bin, NULL below ``min_count``."""
    d = df.select(E.bin_index(x, x_edges).alias("xi"), E.bin_index(y, y_edges).alias("yi"), recovered).where("xi IS NOT NULL AND yi IS NOT NULL")
    g = d.groupBy("xi", "yi").agg(F.count(F.lit(1)).alias("n"), F.count_if(recovered).alias("n_recovered"))
    return g.withColumn("fraction", F.when(F.col("n") >= min_count, F.col("n_recovered") / F.col("n")))


def depth_boundary(grid: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Lowest y bin reaching the threshold per x bin."""
    hit = F.when(F.col("fraction") >= threshold, F.col("yi"))
    return grid.groupBy("xi").agg(F.min(hit).alias("boundary_yi"), F.max("fraction").alias("max_fraction"))


def monotone_boundary(grid: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Running maximum of the fraction along y; threshold crossing by linear interpolation. Groups are grid columns."""
    w = W.partitionBy("xi").orderBy("yi")
    d = grid.where("fraction IS NOT NULL").withColumn("mono", F.max("fraction").over(w))
    d = d.withColumns({"pm": F.lag("mono").over(w), "py": F.lag("yi").over(w)})
    cross = F.when(F.col("pm").isNull() | (F.col("pm") >= threshold), F.col("yi").cast("double")).otherwise(
        F.col("py") + (F.lit(threshold) - F.col("pm")) / F.nullif(F.col("mono") - F.col("pm"), F.lit(0.0)) * (F.col("yi") - F.col("py")))
    return d.where(F.col("mono") >= threshold).withColumn("y_cross", cross).groupBy("xi").agg(F.min_by("y_cross", "yi").alias("y_cross"))


def kernel_surface(df: DataFrame, x: Column, y: Column, recovered: str, xs: Sequence[float], ys: Sequence[float], sx: float, sy: float) -> DataFrame:
    """Gaussian-weighted recovered share and effective sample size on a grid; weights combine map-side."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("gx"), F.lit(float(b)).alias("gy")) for a in xs for b in ys])
    d = df.select(x.alias("x"), y.alias("y"), F.col(recovered).cast("double").alias("r")).select("x", "y", "r", F.explode(grid).alias("g"))
    wgt = F.exp(-0.5 * (F.pow((F.col("x") - F.col("g.gx")) / sx, F.lit(2.0)) + F.pow((F.col("y") - F.col("g.gy")) / sy, F.lit(2.0))))
    g = d.withColumn("w", wgt).groupBy(F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy")).agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("r")).alias("swr"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    return g.select("gx", "gy", fraction(F.col("swr"), F.col("sw")).alias("fraction"), (F.col("sw") * F.col("sw") / F.nullif("sww", F.lit(0.0))).alias("effective_n"))


def smoothed_grid(grid: DataFrame, nx: int, ny: int, sigma: float = 1.0, min_effective: float = 2.0) -> DataFrame:
    """5 x 5 Gaussian-smoothed hit and count grids, zero outside: each cell spreads to its 25 neighbours."""
    import math
    weights = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-2, 3) for j in range(-2, 3)]
    total = sum(w for _, _, w in weights)
    spread = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(w / total).alias("w")) for i, j, w in weights])
    d = grid.select("xi", "yi", "n", "n_recovered", F.explode(spread).alias("k"))
    d = d.select((F.col("xi") + F.col("k.di")).alias("xi"), (F.col("yi") + F.col("k.dj")).alias("yi"),
                 (F.col("n") * F.col("k.w")).alias("n"), (F.col("n_recovered") * F.col("k.w")).alias("h"))
    g = d.where(F.col("xi").between(0, nx - 1) & F.col("yi").between(0, ny - 1)).groupBy("xi", "yi").agg(F.sum("n").alias("count_s"), F.sum("h").alias("hit_s"))
    return g.select("xi", "yi", "count_s", F.when(F.col("count_s") * total >= min_effective, F.col("hit_s") / F.nullif("count_s", F.lit(0.0))).alias("fraction"))


def recall_at_k(labelled: DataFrame, ks: Sequence[int], order: Sequence[Column | str] = ("peak_rank",), id_column: str = "injection_id") -> DataFrame:
    """Share of injections with a true peak among the first K by rank (or by any score order).

    The position of the first true peak decides every K: find it with a struct minimum, then count the
    rows up to it. Both steps combine map-side, so one id with very many peaks is no problem.
    """
    key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    d = labelled.select(id_column, "is_signal", key.alias("_o"))
    first = d.groupBy(id_column).agg(F.min(F.when(F.col("is_signal"), F.col("_o"))).alias("_b"))
    best = d.join(first, id_column).groupBy(id_column).agg(
        F.when(F.first("_b").isNotNull(), F.count_if(F.col("_o") <= F.col("_b"))).alias("best"))
    s = best.agg(F.count(F.lit(1)).alias("denom"), F.count("best").alias("rankable"), *[F.count_if(F.col("best") <= k).alias(f"n_{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n_{k}").alias("n")) for k in ks])).alias("r")
    return s.select("denom", "rankable", rows).select(F.col("r.k").alias("k"), F.col("r.n").alias("n"), "denom", "rankable",
                                                     fraction(F.col("r.n"), F.col("denom")).alias("fraction"), fraction(F.col("r.n"), F.col("rankable")).alias("rankable_fraction"))


def peak_table_summary(labelled: DataFrame) -> DataFrame:
    """Row, injection and positive counts of a labelled peak table."""
    return labelled.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("injection_id").alias("n_injections"), F.count_if("is_signal").alias("n_positive"),
                        F.countDistinct(F.when(F.col("is_signal"), F.col("injection_id"))).alias("n_with_signal"),
                        F.count_if(F.col("match_kind") == "harmonic").alias("n_harmonic"))


def grid_support(manifest: DataFrame, n_period: int, n_radius: int) -> DataFrame:
    """Injections, hosts, reuse and per-cell support (zero cells included) per brightness bin."""
    d = manifest.withColumn("tmag_bin", E.tmag_bin("tmag"))
    cells = d.select("tmag_bin").distinct().select("tmag_bin", F.explode(F.sequence(F.lit(0), F.lit(n_period * n_radius - 1))).alias("cell"))
    counts = d.groupBy("tmag_bin", (F.col("grid_period_bin") * n_radius + F.col("grid_radius_bin")).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    per = cells.join(counts, ["tmag_bin", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    s = per.groupBy("tmag_bin").agg(F.count_if(F.col("n") > 0).alias("cells_represented"), F.min("n").alias("min_support"),
                                    F.percentile("n", 0.1).alias("p10_support"), F.percentile("n", 0.5).alias("median_support"), F.max("n").alias("max_support"))
    h = d.groupBy("tmag_bin").agg(F.count(F.lit(1)).alias("n_injections"), F.countDistinct("tic").alias("n_hosts"))
    return h.join(s, "tmag_bin").withColumn("reuse", F.col("n_injections") / F.col("n_hosts"))


def host_coverage(expected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Targets without injections, unknown hosts, and injections per host."""
    e, m = expected.select("tic").distinct(), manifest.groupBy("tic").agg(F.count(F.lit(1)).alias("n"))
    j = e.withColumn("_e", F.lit(True)).join(m, "tic", "full_outer")
    return j.agg(F.count_if(F.col("n").isNull()).alias("targets_without"), F.count_if(F.col("_e").isNull()).alias("unknown_hosts"),
                 F.min("n").alias("min_per_host"), F.percentile("n", 0.5).alias("median_per_host"), F.max("n").alias("max_per_host"))


def scored_outcomes(manifest: DataFrame, scored: DataFrame, score: str, threshold: float, max_rank: int = 5) -> DataFrame:
    """End-to-end outcome per injection: found by the search, then kept by the score threshold."""
    s = scored.where(F.col("peak_rank") <= max_rank)
    g = s.groupBy("injection_id").agg(F.bool_or("is_signal").alias("_found"), F.bool_or(F.col("is_signal") & (F.col(score) >= threshold)).alias("_kept"),
                                      F.max(F.when(F.col("is_signal"), F.col(score))).alias("max_signal_score"), F.max(score).alias("max_score"))
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return manifest.join(g, "injection_id", "left").withColumns({"found": f("_found"), "kept": f("_kept")}).drop("_found", "_kept")


def outcome_fractions(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    g = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"), F.count_if("kept").alias("n_kept"))
    return g.withColumns({"found_fraction": fraction(F.col("n_found"), F.col("n")), "kept_fraction": fraction(F.col("n_kept"), F.col("n")),
                          "kept_given_found": fraction(F.col("n_kept"), F.col("n_found"))})


def compare_models(tables: dict[str, DataFrame]) -> DataFrame:
    """End-to-end and conditional fractions of several models on the ids they all share."""
    names = list(tables)
    j = None
    for n in names:
        t = tables[n].select("injection_id", F.col("found").alias(f"{n}_found"), F.col("kept").alias(f"{n}_kept"))
        j = t if j is None else j.join(t, "injection_id")
    s = j.agg(F.count(F.lit(1)).alias("n_common"), *[F.count_if(f"{n}_{k}").alias(f"{n}_{k}") for n in names for k in ("found", "kept")])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"{n}_found").alias("n_found"), F.col(f"{n}_kept").alias("n_kept")) for n in names])).alias("m")
    return s.select("n_common", rows).select("m.model", "n_common", "m.n_found", "m.n_kept", fraction(F.col("m.n_kept"), F.col("n_common")).alias("end_to_end"),
                                             fraction(F.col("m.n_kept"), F.col("m.n_found")).alias("conditional"))


def branch_diff(base: DataFrame, branch: DataFrame, scope: str = "union") -> DataFrame:
    """Per-injection outcome change between two search branches; rescued beats reranked beats degraded."""
    cut = lambda d, p: d.select("injection_id", F.col("topk").alias(f"{p}_topk"), F.col("best_signal_rank").alias(f"{p}_rank"))
    j = cut(base, "base").join(cut(branch, "branch"), "injection_id", "inner" if scope == "intersection" else "full_outer")
    bt, nt = F.coalesce("base_topk", F.lit(False)), F.coalesce("branch_topk", F.lit(False))
    status = (F.when(~bt & nt, "rescued").when(bt & ~nt, "degraded")
              .when(bt & nt & (F.col("branch_rank") < F.col("base_rank")), "reranked_up").when(bt & nt & (F.col("branch_rank") > F.col("base_rank")), "reranked_down")
              .when(bt & nt, "same").otherwise("missed_both"))
    return j.withColumn("change", status)


def preset_confusion(df: DataFrame, presets: dict[str, Column], label: str, current: str) -> DataFrame:
    """tp/fp/fn/tn, rates and rows added over the current preset, all presets in one pass."""
    t = F.col(label)
    cur = presets[current]
    aggs = []
    for n, p in presets.items():
        aggs += [F.count_if(p & t).alias(f"{n}_tp"), F.count_if(p & ~t).alias(f"{n}_fp"), F.count_if(~p & t).alias(f"{n}_fn"), F.count_if(~p & ~t).alias(f"{n}_tn"),
                 F.count_if(p & ~cur).alias(f"{n}_added")]
    keys = ("tp", "fp", "fn", "tn", "added")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), *[F.col(f"{n}_{k}").alias(k) for k in keys]) for n in presets])).alias("p")
    s = df.agg(*aggs).select(rows).select("p.*")
    return s.withColumns({"precision": fraction(F.col("tp"), F.col("tp") + F.col("fp")), "recall": fraction(F.col("tp"), F.col("tp") + F.col("fn")),
                          "specificity": fraction(F.col("tn"), F.col("tn") + F.col("fp"))})


def best_of_group(df: DataFrame, keys: Sequence[str], aperture: str, snr: str, recoverable: float) -> DataFrame:
    """Per aperture: rows, share above the S/N limit, median and p90; best-of-group appended as '*'."""
    best = df.groupBy(*keys).agg(F.max(snr).alias(snr)).withColumn("_ap", F.lit("*"))
    stat = lambda d: d.groupBy("_ap").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(snr) >= recoverable).alias("n_recoverable"))
    own = df.select(snr, F.col(aperture).alias("_ap"))
    # apertures are few, so their quantiles come from counts of distinct values that tasks share, never from one task's values
    levels = cut_lineage(own.unionByName(best.select(snr, "_ap")).where(robust.finite(F.col(snr).cast("double"))).groupBy("_ap", F.col(snr).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    q = robust.level_quantiles(levels, "_ap", "_v", "_n", {"median_snr": 0.5, "p90_snr": 0.9})
    return stat(own).unionByName(stat(best)).join(F.broadcast(q), F.col("_ap").eqNullSafe(F.col("_key")), "left").drop("_key").withColumnRenamed("_ap", "aperture")


def current_vs_best(df: DataFrame, keys: Sequence[str], aperture: str, current: str, snr: str, recoverable: float) -> DataFrame:
    """S/N in the current aperture against the best one, with gain and newly recoverable flag: one aggregate."""
    g = df.groupBy(*keys).agg(F.max(F.when(F.col(aperture) == current, F.col(snr))).alias("current_snr"), F.max(snr).alias("best_snr"),
                              F.max_by(aperture, F.struct(snr, aperture)).alias("best_aperture"))
    return g.withColumns({"gain": F.col("best_snr") - F.col("current_snr"),
                          "newly_recoverable": (F.col("best_snr") >= recoverable) & (F.coalesce("current_snr", F.lit(0.0)) < recoverable)})


def sweep_deltas(matches: DataFrame, baseline: str) -> DataFrame:
    """New, lost and net matched injections of each sweep against the baseline sweep."""
    base = matches.where((F.col("sweep") == baseline) & F.col("matched")).select("injection_id").distinct().withColumn("_b", F.lit(True))
    hit = matches.where("matched").select("sweep", "injection_id").distinct().join(base, "injection_id", "left")
    n_base = base.agg(F.count(F.lit(1)).alias("n_baseline"))
    g = hit.groupBy("sweep").agg(F.count(F.lit(1)).alias("n_matched"), F.count_if(F.col("_b").isNull()).alias("n_new"), F.count("_b").alias("n_kept"))
    return g.transform(with_row, n_base).select("sweep", "n_matched", "n_new", (F.col("n_baseline") - F.col("n_kept")).alias("n_lost"),
                                                          (F.col("n_new") - F.col("n_baseline") + F.col("n_kept")).alias("net"))


def retention_fit(pairs: DataFrame, keys: Sequence[str], min_rows: int = 10) -> DataFrame:
    """Regression of the measured loss -(injected - original) on the injected loss 1 - model: slope is the retention."""
    x, y = 1 - F.col("model"), F.col("original") - F.col("injected")
    inside = F.col("model") < 1
    g = pairs.groupBy(*keys).agg(F.count_if(inside).alias("n_in"), F.regr_slope(F.when(inside, y), F.when(inside, x)).alias("_s"),
                                 F.regr_intercept(F.when(inside, y), F.when(inside, x)).alias("_i"), F.corr(F.when(inside, y), F.when(inside, x)).alias("_c"))
    ok = F.col("n_in") >= min_rows
    return g.select(*keys, "n_in", F.when(ok, F.col("_s")).alias("retention"), F.when(ok, F.col("_i")).alias("offset"), F.when(ok, F.col("_c")).alias("correlation"),
                    F.when(ok, "ok").otherwise("too_few_cadences").alias("status"))


def recovery_classes(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Strict (rank-1 exact), top-N exact, harmonic and any recovery per injection, in that precedence."""
    g = df.groupBy("injection_id").agg(
        F.bool_or((F.col("match_kind") == "exact") & (F.col("peak_rank") == 1)).alias("strict"),
        F.bool_or((F.col("match_kind") == "exact") & (F.col("peak_rank") <= top_n)).alias("topn_exact"),
        F.bool_or((F.col("match_kind") == "harmonic") & (F.col("peak_rank") <= top_n)).alias("topn_harmonic"))
    mode = (F.when(F.col("strict"), "bls_top1_recovered").when(F.col("topn_exact"), "bls_topn_recovered")
            .when(F.col("topn_harmonic"), "bls_topn_harmonic_match").otherwise("bls_mismatch"))
    return g.withColumns({"any_recovered": F.col("strict") | F.col("topn_exact") | F.col("topn_harmonic"), "recovery_mode": mode})


def debug_reasons(failures: DataFrame, apertures: DataFrame) -> DataFrame:
    """Failure class joined to aperture evidence; reasons joined with '+', else context."""
    j = failures.join(apertures, "injection_id", "left")
    reason = F.concat_ws("+", F.when(F.col("ranking_loss"), F.lit("ranking_loss")), F.when(F.col("newly_recoverable"), F.lit("newly_recoverable")))
    return j.withColumn("reason", F.when(reason == "", "context").otherwise(reason))


def mode_by_bin(df: DataFrame, bin_col: str, mode_col: str, modes: Sequence[str]) -> DataFrame:
    """Counts of each mode per bin, zero-filled."""
    return df.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(mode_col) == m).alias(m) for m in modes])
