from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumensift.operators import cadence as C, search as S, vet as V

CFG = S.SearchConfig(n_periods=300, p_min_d=0.5, durations_min=(16.0, 20.0, 30.0), n_peaks=3)


@pytest.fixture(scope="module")
def prepared(spark, planted):
    q = S.with_integer_flux(C.clean(spark.createDataFrame(planted)))
    return q, S.curve_stats(q, CFG)


def test_plans_agree_and_find_the_planted_period(spark, planted, prepared):
    q, st = prepared
    a = S.with_sde(S.spectrum_packed(q, st, CFG)).toPandas().sort_values(["aperture", "period_idx"]).reset_index(drop=True)
    b = S.with_sde(S.spectrum_binned(q, st, CFG)).toPandas().sort_values(["aperture", "period_idx"]).reset_index(drop=True)
    assert len(a) == len(b)
    for c in ("period_d", "power", "depth", "depth_snr", "duration_min", "t0", "n_in", "sde"):
        assert np.allclose(a[c], b[c], rtol=1e-12), c
    fine = replace(CFG, n_periods=2000)
    best = S.with_sde(S.spectrum_packed(q, st, fine)).toPandas().sort_values("sde").iloc[-1]
    assert abs(best["period_d"] / 1.5 - 1) < 0.01
    assert abs((best["t0"] - 0.2 + 0.75) % 1.5 - 0.75) < 20 / 1440


def test_binned_spectra_in_tasks_equal_the_shuffled_grid(spark, planted):
    short = planted.assign(tic=8)[planted.time < 6]
    q = S.with_integer_flux(C.clean(spark.createDataFrame(pd.concat([planted, short])), CFG.min_cadences, 0.0, CFG.sigma_clip))
    st = S.curve_stats(q, CFG)
    d = S.spectrum_binned(q, st, CFG, hot=False, task_rows=50_000)
    assert "period_idx" not in "".join(x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, S.spectrum_binned(q, st, CFG).select(d.columns).collect()))


def test_small_chunks_change_nothing(prepared):
    q, st = prepared
    f = lambda c: sorted(map(tuple, S.spectrum_packed(q, st, c).collect()))
    assert f(CFG) == f(replace(CFG, chunk_periods=37))


def test_fold_matches_brute_force():
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 20, 90))
    y = np.rint(rng.normal(0, 1e7, 90)).astype(np.int64)
    w, boxes = 0.05, [(1, 72.0), (3, 216.0)]
    periods = np.array([0.7, 1.9, 3.3])
    power, n_in, o = S._fold_chunk(t, y, periods, w, boxes, 90, int(y.sum()))
    for i, p in enumerate(periods):
        b = np.floor(np.mod(t, p) / w).astype(int)
        nb, best = int(np.ceil(p / w)), (-1.0, 0)
        for k, _ in boxes:
            for s in np.unique(b):
                sel = ((b >= s) & (b < s + k)) | ((b + nb < s + k) & (b < 2))
                n = sel.sum()
                if n == 90:
                    continue
                d = ((y.sum() - y[sel].sum()) / (90 - n) - y[sel].sum() / n) / 1e9
                if d > 0 and 0.5 * n * d * d > best[0]:
                    best = (0.5 * n * d * d, n)
        assert np.isclose(power[i], best[0]) and n_in[i] == best[1]


def test_walk_is_symmetric_in_harmonics_and_respects_quotas():
    p = np.linspace(0.5, 10, 2000)
    for strong, weak in ((2.0, 6.0), (6.0, 2.0)):
        s = np.exp(-((p - strong) / 0.01) ** 2) * 10 + np.exp(-((p - weak) / 0.01) ** 2) * 8 + np.exp(-((p - 4.6) / 0.01) ** 2) * 5
        got = p[S.separated_peaks(p, s, 2, 0.005)]
        assert abs(got[0] - strong) < 0.01 and abs(got[1] - 4.6) < 0.01
    idx = S.separated_peaks(p, np.arange(p.size, dtype=float), 10, 1e-4, (0.5, 5.0, 10.1), 2)
    assert np.histogram(p[idx], [0.5, 5.0, 10.1])[0].tolist() == [2, 2]
    assert S.separated_peaks(p, np.full(p.size, np.nan), 5, 0.01) == []


def test_native_and_array_walks_agree(prepared):
    q, st = prepared
    spec = S.with_sde(S.spectrum_packed(q, st, CFG))
    f = lambda d: sorted((r["aperture"], r["peak_rank"], r["period_idx"]) for r in d.collect())
    assert f(S.pick_peaks(spec, CFG)) == f(S.pick_peaks_native(spec, CFG))


def test_end_to_end_one_cluster_with_both_apertures(spark, planted):
    df = spark.createDataFrame(planted)
    rows = S.search(df, replace(CFG, n_periods=2000))
    top = rows.where("peak_rank = 1").collect()
    assert {r["aperture"] for r in top} == {"SML", "PRI"} and all(abs(r["period_d"] / 1.5 - 1) < 0.01 for r in top)
    peaks = rows.where("peak_rank = 1").select("tic", F.lit(1).alias("sector"), F.lit(1).alias("cam"), F.lit(1).alias("ccd"), F.lit(18.0).alias("tmag"), "aperture", "peak_rank", "period_d",
                                               F.col("t0").alias("t0_bjd"), "duration_min", "depth", "depth_snr", "sde", F.col("n_all").alias("n_cad_kept"), "baseline_d", "status", F.lit("r").alias("bls_run_id"))
    c = S.consolidate(peaks, ["SML", "PRI"]).collect()
    assert len(c) == 1 and c[0]["n_apertures_agree"] == 2
    short = S.search(df.where("cadenceno < 50"), CFG).collect()
    assert {r["status"] for r in short} == {"too_few_cadences"} and {r["peak_rank"] for r in short} == {0}
    q = S.with_integer_flux(C.clean(df))
    fine = S.refine(q, S.curve_stats(q, CFG), rows.where("peak_rank = 1"), 0.01, 201, CFG).collect()
    assert all(abs(r["period_d"] / 1.5 - 1) < 0.003 for r in fine)


def greedy(rows):
    rows, out = sorted(rows, key=lambda r: (-r[2], r[3])), []
    while rows:
        seed = rows[0]
        near = lambda r: min(abs(r[0] - seed[0] * f) / (seed[0] * f) for f in (1, 0.5, 2)) < 0.005 and abs((r[1] - seed[1] + seed[0] / 2) % seed[0] - seed[0] / 2) * 1440 <= 5
        out.append(frozenset([seed[3], *[r[3] for r in rows[1:] if near(r)]]))
        rows = [r for r in rows[1:] if not near(r)]
    return set(out)


def test_components_never_split_a_cluster(spark):
    rng = np.random.default_rng(8)
    base = rng.uniform(0.2, 8, 40)
    p = np.concatenate([base, base * 2 * (1 + rng.normal(0, 0.001, 40)), base / 2, [1.0, 0.99999, 2.00001, 0.50001]])
    pdf = pd.DataFrame({"tic": 1, "sector": 1, "cam": 1, "ccd": 1, "tmag": 18.0, "aperture": "SML", "peak_rank": np.arange(p.size), "period_d": p, "t0_bjd": 2457000.0, "duration_min": 10.0, "depth": 0.1,
                        "depth_snr": 9.0, "sde": rng.uniform(8, 30, p.size), "n_cad_kept": 500, "baseline_d": 27.0, "status": "ok", "bls_run_id": "r"})
    got = S.consolidate(spark.createDataFrame(pdf), ["SML"]).collect()
    want = greedy(list(zip(p, pdf["t0_bjd"], pdf["sde"], pdf["peak_rank"])))
    assert sorted(r["n_members"] for r in got) == sorted(len(w) for w in want)
    lead = {max(w, key=lambda i: pdf["sde"][i]) for w in want}
    assert {r["rep_peak_rank"] for r in got} == lead


def test_truth_labels_need_overlapping_windows(spark):
    truth = spark.createDataFrame([(1, 2.0, 10.0, 20.0, 0.1, 18.0, 0, 0, 5)], "injection_id int, truth_period_d double, truth_t0_bjd double, truth_duration_min double, model_depth double, tmag double, grid_period_bin int, grid_radius_bin int, n_good_in_transit int")
    rows = [("exact", 2.001, 10.0), ("harmonic", 4.0, 10.0), ("harmonic", 1.0, 12.0), ("mismatch", 2.0, 10.5), ("mismatch", 3.1, 10.0)]
    pk = spark.createDataFrame([(1, i, k, p, t, 20.0) for i, (k, p, t) in enumerate(rows)], "injection_id int, i int, want string, period_d double, t0_bjd double, duration_min double")
    got = V.truth_labelled(pk, truth).collect()
    assert len(got) == 5 and all(r["match_kind"] == r["want"] for r in got)


def test_vet_classes(spark):
    d = spark.createDataFrame([(1, 5.0, 10.0), (2, 0.05, 10.0), (3, 0.05, 200.0), (4, 0.15, 5.0), (5, 9.0, 30.0)], "tic int, period_d double, duration_min double")
    got = {r["tic"]: r["vet_class"] for r in V.vet_features(d, 30.0).collect()}
    assert (got[1], got[4], got[5]) == ("planet_candidate", "sub_roche_pceb_suspect", "pceb_grid_ceiling")
    # a period below the alias wall whose duration also breaks the envelope counts as a duration violator
    assert got[3] == "duration_violator"
    assert got[2] in ("alias_artifact", "duration_violator")


def test_folds_by_bin_sums_equal_folds_by_order(monkeypatch):
    rng = np.random.default_rng(7)
    boxes = [(1, 120.0), (2, 240.0), (3, 360.0), (5, 600.0)]
    used = []
    by_bin, by_order = S._bin_sums, S._sorted_sums
    monkeypatch.setattr(S, "_bin_sums", lambda *a: used.append(1) or by_bin(*a))
    for i in range(60):
        n = int(rng.integers(1, 300))
        t = np.sort(rng.integers(0, 2000, n) / 48.0) - 0.0
        t -= t[0]
        y = rng.integers(-10**8, 10**8, n)
        periods = rng.uniform(0.1, 12, 40) if i % 2 else np.arange(1, 41) / 12.0
        args = (t, y, periods, 120.0 / 1440.0, boxes, n, int(y.sum()))
        got = S._fold_chunk(*args)
        with monkeypatch.context() as m:
            m.setattr(S, "_bin_sums", by_order)
            want = S._fold_chunk(*args)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and all((got[2][k] == want[2][k]).all() for k in want[2])
    assert 20 < len(used) < 60


def test_curves_are_packed_once_for_search_and_refinement(spark, prepared, monkeypatch):
    q, st = prepared
    packed = S.packed_curves(q, CFG)
    assert not packed._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")  # written, not cleaned again by what follows
    key = lambda d: sorted(map(str, map(tuple, d.collect())))
    assert key(packed.drop("c").select(*st.columns)) == key(st)
    assert key(S.fold_packed(packed, CFG)) == key(S.spectrum_packed(q, st, CFG))
    top = S.pick_peaks(S.with_sde(S.fold_packed(packed, CFG)), replace(CFG, n_peaks=1))
    assert key(S.refine_packed(packed, top, 0.01, 51, CFG)) == key(S.refine(q, st, top, 0.01, 51, CFG))


def test_folds_into_bins_equal_folds_of_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    by_chunk, fell_back = S._fold_chunk, []
    monkeypatch.setattr(S, "_fold_chunk", lambda *a: fell_back.append(1) or by_chunk(*a))
    for i in range(400):
        boxes = [[(1, 120.0), (2, 240.0), (3, 360.0), (5, 600.0)], [(1, 72.0), (3, 216.0)], [(1, 5.0)], [(2, 3.0), (7, 8.0)]][i % 4]
        n = int(rng.integers(2, 200))
        t = np.sort(rng.integers(0, 2000, n) / 48.0) if i % 3 else np.sort(rng.uniform(0, 30, n))
        t -= t[0]
        y = rng.integers(-3, 4, n) * 10**7 if i % 5 == 0 else np.full(n, 5) if i % 7 == 0 else rng.integers(-10**8, 10**8, n)
        args = (t, y, np.sort(rng.uniform(0.3, 12, 40)) if i % 2 else np.arange(1, 41) / 12.0, (120.0 / 1440.0, 0.05)[i % 2], boxes, n, int(y.sum()))
        got, want = S._fold_bins(*args), by_chunk(*args)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and all((got[2][k] == want[2][k]).all() for k in want[2])
    assert len(fell_back) < 200


def test_whole_grid_leaves_no_dip_between_two_periods(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 30, 400))
    coarse = S.SearchConfig(n_periods=100, p_min_d=1.0, durations_min=(120.0, 240.0), min_cadences=20)
    whole = replace(coarse, max_drift=1.0)
    f_min = 1 / (0.45 * (t[-1] - t[0]))
    period = 1 / (1 - 33.5 * (1 - f_min) / 99)  # between two periods of the coarse grid
    y = 1 + rng.normal(0, 0.01, t.size) - 0.05 * (np.mod(t - 0.3, period) < 0.08)
    q = S.with_integer_flux(spark.createDataFrame(pd.DataFrame({"tic": 1, "aperture": "SML", "time": t, "orbitid": 0, "y": y})))
    best = {}
    for cfg in (coarse, whole):
        st = S.curve_stats(q, cfg)
        d = S.spectrum_binned(q, st, cfg, hot=False)
        assert "Window" not in d._jdf.queryExecution().executedPlan().toString()  # the grid's rows aren't made
        rows = sorted(map(tuple, d.collect()))
        assert rows == sorted(map(tuple, S.spectrum_binned(q, st, cfg).select(d.columns).collect())) == sorted(map(tuple, S.spectrum_packed(q, st, cfg).select(d.columns).collect()))
        p = np.array(sorted(r[3] for r in rows))
        drift = np.diff(p) / p[:-1] * (t[-1] - t[0]) / (120 / 1440)
        best[cfg.max_drift] = max(rows, key=lambda r: r[4])[3], drift.max()
    assert abs(best[1.0][0] / period - 1) < 0.002 and best[1.0][1] <= 1.001
    assert best[None][1] > 10
