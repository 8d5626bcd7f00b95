import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumensift.operators import contracts as C, shared_grid as G, splits as S, training_rows as T

GRID = G.SharedGrid(n_periods=60, p_min_d=0.5, p_max_d=4.0, durations_min=(10.0, 20.0, 30.0), min_cadences=50, chunk_periods=25, cells=30_000)


def plain_power(time, q, t_min, periods, grid):
    """One box after another over the bins of one period."""
    w, boxes = grid.widths()
    out = []
    for p in periods:
        own = int(np.ceil(p / w))
        bins = np.floor(np.mod(time - t_min, p) / w).astype(int)
        n, s = np.bincount(bins, minlength=own), np.bincount(bins, q, own)
        best = np.nan
        for b in np.flatnonzero(n):
            for k in boxes:
                at = [(b + j) % own for j in range(k)]
                n_in, s_in = n[at].sum(), s[at].sum()
                if n_in < len(q):
                    depth = ((q.sum() - s_in) / (len(q) - n_in) - s_in / n_in) / 1e9
                    if depth > 0:
                        best = np.nanmax([best, 0.5 * n_in * depth * depth])
        out.append(best)
    return np.array(out)


@pytest.fixture(scope="module")
def two_apertures(planted):
    pdf = planted.copy()
    rng = np.random.default_rng(3)
    pri = pdf.aperture == "PRI"
    pdf.loc[pri, "flux"] = 3 * (1 - 0.5 * (1 - pdf.flux[pri])) + rng.normal(0, 1e-3, pri.sum())
    pdf.loc[pdf.cadenceno % 17 == 0, "flux"] = np.where(pdf.aperture[pdf.cadenceno % 17 == 0] == "SML", np.nan, 3.5)
    pdf.loc[pdf.cadenceno % 23 == 0, "quality"] = 1
    few = pdf[pdf.cadenceno < 40].assign(tic=8)
    return pd.concat([pdf, few], ignore_index=True)


def test_shared_grid_equals_plain_sums(spark, two_apertures):
    c = spark.createDataFrame(two_apertures)
    got = G.shared_spectrum(c, "SML", "PRI", GRID).toPandas().sort_values(["tic", "period_idx"])
    assert len(got) == 120 and got[got.tic == 8][["power_small", "sde_primary"]].isna().all().all()
    rows = G.masked(G.paired(c, "SML", "PRI"), GRID).where("tic = 7").toPandas()
    one = got[got.tic == 7]
    for a in G.APERTURES:
        have = rows[rows[f"q_{a}"].notna()]
        want = plain_power(have.time.to_numpy(), have[f"q_{a}"].to_numpy(), rows.time.min(), one.period_d.to_numpy(), GRID)
        assert np.allclose(one[f"power_{a}"], want, rtol=1e-12, equal_nan=True)
        x = want - np.nanmedian(want)
        assert np.allclose(one[f"sde_{a}"], x / (1.4826 * np.nanmedian(np.abs(x))), rtol=1e-9, equal_nan=True)
    # bright outliers of the primary aperture are out of it alone
    assert rows.q_primary.notna().sum() < rows.q_small.notna().sum() + 1 and rows.q_primary.max() < 2e8


def test_blocks_and_hot_plan_give_the_same_spectrum(spark, two_apertures):
    c = spark.createDataFrame(two_apertures)
    key = lambda d: d.orderBy("tic", "period_idx").toPandas()
    want = key(G.shared_spectrum(c, "SML", "PRI", GRID))
    from dataclasses import replace
    pd.testing.assert_frame_equal(key(G.shared_spectrum(c, "SML", "PRI", replace(GRID, block_rows=300))), want)
    pd.testing.assert_frame_equal(key(G.shared_spectrum(c, "SML", "PRI", replace(GRID, block_rows=700), hot=True)), want)
    assert G.shared_spectrum(c.limit(0), "SML", "PRI", GRID).count() == 0


@pytest.mark.parametrize("block", [None, 4])
def test_balanced_folds_keep_groups_whole_within_the_bound(spark, block):
    rng = np.random.default_rng(5)
    size = np.minimum(rng.zipf(1.7, 400), 60)
    g = np.repeat(np.arange(400), size)
    rows = pd.DataFrame({"g": g, "label": np.where(rng.random(g.size) < 0.05, "rare", np.where(g % 3 == 0, "a", "b")), "x": 1})
    d = spark.createDataFrame(rows)
    a = S.balanced_assignment(d, "g", "label", 5, 1, block)
    rep = S.balance_report(a, 5).first()
    assert rep.n_groups == 400 and rep.n_split == 0 and rep.imbalance <= rep.bound + 1e-9
    # the same figures from the rows themselves
    p = rows.merge(a.select("g", "fold").toPandas(), on="g")
    assert len(p) == len(rows) and p.groupby("g").fold.nunique().max() == 1
    t = p.groupby(["label", "fold"]).size().unstack(fill_value=0).reindex(columns=range(5), fill_value=0)
    cost = sum(((t.loc[k] - t.loc[k].mean()) ** 2).sum() / max(t.loc[k].mean(), 1) for k in t.index) + 0.1 * ((t.sum() - t.sum().mean()) ** 2).sum() / t.sum().mean()
    assert abs(cost - rep.imbalance) < 1e-6
    # no worse than dealing groups at random, and every label is near its share
    rand = [rows.assign(fold=rng.integers(0, 5, 400)[rows.g]) for _ in range(20)]
    spread = lambda q: sum(((c - c.mean()) ** 2).sum() / max(c.mean(), 1) for _, c in q.groupby(["label", "fold"]).size().unstack(fill_value=0).iterrows())
    assert spread(p) < min(spread(q) for q in rand)


def test_equal_groups_are_dealt_exactly_and_odd_input_is_refused(spark):
    d = spark.range(300).select((F.col("id") % 100).alias("g"), F.lit("a").alias("label"))
    assert sorted(r["count"] for r in S.balanced_folds(d, "g", "label", 5, 1).groupBy("fold").count().collect()) == [60] * 5
    split = S.holdout_and_cv_folds(d, "g", "label", 1).groupBy("fixed_split", "cv_fold").count().toPandas()
    assert split[split.fixed_split == "test"].cv_fold.tolist() == [-1] and sorted(split["count"]) == [48] * 5 + [60]
    assert S.balanced_folds(d.limit(0), "g", "label", 5, 1).count() == 0
    one = S.balanced_folds(d.where("g = 3").withColumn("label", F.lit(None).cast("string")), "g", "label", 5, 1)
    assert one.select("fold").distinct().count() == 1 and one.count() == 3
    with pytest.raises(ValueError):
        S.balanced_folds(d.withColumn("g", F.lit(None).cast("string")), "g", "label", 5, 1)
    with pytest.raises(ValueError):
        S.balanced_folds(d, "g", "label", 1, 1)


def test_availability_and_masks_read_text_flags(spark):
    d = spark.createDataFrame([(1, "Yes"), (2, "no"), (3, None), (None, "true")], "tic bigint, native_input_include string")
    have = spark.createDataFrame([(1,), (1,), (2,)], "tic bigint")
    got = {r.tic: r.input_status for r in T.mark_availability(d, have).collect()}
    assert got == {1: "available", 2: "excluded_upstream", 3: "excluded_upstream", None: "missing_source"}
    assert [r[0] for r in d.orderBy("tic").select(T.include_mask(d.columns)).collect()] == [True, True, False, False]
    assert not spark.range(1).select(T.include_mask(["id"])).first()[0]


def test_splits_carry_over_or_fail(spark):
    rows = spark.createDataFrame([("a", "planet_like"), ("b", "skip"), ("c", "uncertain")], "review_id string, human_label string")
    prior = spark.createDataFrame([("a", 1, "test", 0), ("a", 2, "development", 3), ("c", 1, "development", None)], "review_id string, v int, fixed_split string, cv_fold int")
    assert [tuple(r) for r in T.split_problems(rows, prior, "v").collect()] == [("c", "uncertain")]
    with pytest.raises(ValueError, match="earlier split"):
        T.attach_prior_splits(rows, prior, "v")
    got = T.attach_prior_splits(rows.where("review_id <> 'c'"), prior, "v").orderBy("review_id").collect()
    assert [(r.review_id, r.fixed_split, r.cv_fold) for r in got] == [("a", "development", 3), ("b", None, None)]
    with pytest.raises(ValueError):
        T.attach_prior_splits(rows.union(rows), prior, "v")


def test_injection_rows_need_a_role_and_a_supported_factor(spark):
    roles = spark.createDataFrame([(1, "test", -1), (2, "development", 0)], "injection_id int, fixed_split string, cv_fold int")
    c = spark.createDataFrame([("x", 1, True, 0.501), ("y", 1, False, 9.0), ("z", 2, False, 1.0)], "review_id string, injection_id int, is_match boolean, harmonic_factor double")
    got = {r.review_id: (r.training_role, r.compact_target_index, r.harmonic_target, r.harmonic_target_index) for r in T.injection_rows(c, roles).collect()}
    assert got == {"x": ("compact_positive", 1, "p_over_2", 2), "x:paired_original": ("paired_pre_injection", 0, "", -1), "y": ("same_lc_unmatched_peak", 0, "", -1)}
    with pytest.raises(ValueError, match="unsupported"):
        T.injection_rows(c.withColumn("is_match", F.lit(True)), roles)
    with pytest.raises(ValueError, match="outside"):
        T.injection_rows(c, roles.where("injection_id = 2"))
    with pytest.raises(ValueError):
        T.scoped_truth(roles, roles.where("injection_id = 1"))


def test_fold_weights_ignore_held_out_rows(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"k": range(200), "t": rng.choice([-1, 0, 1, 2], 200, p=[.1, .6, .25, .05]), "is_injected_row": rng.random(200) < 0.5, "human_label": np.where(rng.random(200) < 0.4, "planet_like", "other"), "f": rng.integers(0, 5, 200)})
    got = T.fold_weights(spark.createDataFrame(p), F.col("f") != 0, {"t": "w"}).toPandas().set_index("k").w.sort_index().to_numpy()
    fit = (p.f != 0) & (p.t >= 0)
    n = p[fit].t.value_counts()
    w = np.where(fit, np.minimum(4, np.sqrt(n.max() / p.t.map(n))), 0.0)
    w[fit] /= w[fit].mean()
    for t in n.index:
        at, planet = fit & (p.t == t), p.human_label == "planet_like"
        real = w[at & ~p.is_injected_row].sum()
        for m, lim in ((at & p.is_injected_row & planet, real), (at & p.is_injected_row & ~planet, 0.25 * real)):
            if real > 0 and w[m].sum() > lim:
                w[m] *= lim / w[m].sum()
    w[w > 0] /= w[w > 0].mean()
    assert np.allclose(got, w)
    changed = p.assign(t=np.where(p.f == 0, 2, p.t))
    again = T.fold_weights(spark.createDataFrame(changed), F.col("f") != 0, {"t": "w"}).toPandas().set_index("k").w.sort_index().to_numpy()
    assert np.allclose(again, got)


def test_locked_rows_refuse_bad_scores(spark):
    rows = spark.createDataFrame([("a", "test", "real_human_morphology", 0), ("b", "test", "real_human_morphology", 1), ("c", "development", "real_human_morphology", 1)], "review_id string, fixed_split string, training_role string, morphology_target_index int")
    s = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.1, 0.9)], "review_id string, p_x double, p_y double")
    got = T.locked_rows(rows, s, s, ("x", "y"))
    assert {r.review_id: r.new_predicted for r in got.collect()} == {"a": "x", "b": "y"}
    r = T.compare_locked(got, ("x", "y")).first()
    assert r.n == 2 and r.delta == 0 and r.passed
    assert not T.compare_locked(got, ("x", "y", "z")).first().passed
    for bad in (s.where("review_id = 'a'"), s.union(s), s.withColumn("p_x", F.lit(0.9)), s.withColumn("p_x", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="old scores"):
            T.locked_rows(rows, s, bad, ("x", "y"))


def test_contract_names_and_missing_columns(spark):
    pair = C.PairContract(("SML", "PRI"))
    assert C.forbidden_columns(["raw_flux_small", "RAW_FLUX_DETRENDED_SML", "sml_depth", "small_depth"], pair) == ["raw_flux_small", "sml_depth"]
    with pytest.raises(ValueError):
        C.require_pair(["PRI", "SML"], pair)
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "review_id string, sml_x double")
    m = C.latest_metrics([spark.createDataFrame([("a", 1.0)], "review_id string, small_period_d double"), spark.createDataFrame([("a", 2.0, 7)], "review_id string, small_period_d double, other int")], pair)
    out = C.contract_frame(df, m, pair)
    assert "sml_x" not in out.columns and "other" not in out.columns
    assert {r.review_id: (r.exclusion_reason, r.small_period_d) for r in out.collect()} == {"a": ("missing_small_anchor", 2.0), "": ("missing_small_anchor", None)}
    with pytest.raises(ValueError):
        C.contract_problems(df, pair)


def test_injection_rows_read_their_candidates_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(x):
        made.add(1)
        return x

    c = spark.range(40).select(seen("id").alias("review_id"), F.floor(F.col("id") / 4).alias("injection_id"), (F.col("id") % 4 == 1).alias("is_match"), F.lit(1.0).alias("harmonic_factor"))
    roles = spark.range(10).select(F.col("id").alias("injection_id"), F.lit("test").alias("fixed_split"), F.lit(1).alias("cv_fold"))
    assert T.injection_rows(c, roles).count() == 50
    assert made.value == 40
