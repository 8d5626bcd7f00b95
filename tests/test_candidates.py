import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumensift.operators import candidates as X, injection_search as R, search as S

COLS = ["review_id", "tic", "period_d", "t0_bjd", "duration_min", "small_period_d", "small_t0_bjd", "small_duration_min", "primary_period_d", "primary_t0_bjd", "primary_duration_min"]
SCHEMA = "review_id bigint, tic bigint, " + ", ".join(f"{c} double" for c in COLS[2:])


@pytest.fixture(scope="module")
def cadences(planted):
    a = planted.assign(sector=1)
    b = a[a.time < 4].assign(tic=8)
    b = b[b.aperture == "SML"]
    return pd.concat([a, b], ignore_index=True)


def plain(d, tic, ap, p, t0, dur):
    """The rule for one ephemeris, over all cadences of the curve."""
    c = d[(d.tic == tic) & (d.aperture == ap) & (d.quality == 0) & np.isfinite(d.flux)]
    y, t = (c.flux / c.flux.median()).to_numpy(), c.time.to_numpy()
    m = np.abs((t - t0 + p / 2) % p - p / 2) * 1440
    inside, out = m <= dur / 2, (m > max(dur, 20)) & (m < 90)
    odd = np.rint((t - t0) / p).astype(int) % 2 == 1
    med = lambda x: np.median(x) if x.size else np.nan
    n = [int((inside & o).sum()) for o in (odd | True, ~odd, odd)]
    if out.sum() < 10:
        return [n[0], np.nan, np.nan, n[1], n[2], np.nan, np.nan]
    om = np.median(y[out])
    s = 1.4826 * np.median(np.abs(y[out] - om))
    dep = om - med(y[inside])
    return [n[0], dep, dep / s * np.sqrt(n[0]), n[1], n[2], om - med(y[inside & ~odd]), om - med(y[inside & odd])]


CANDIDATES = [
    (1, 7, 1.5, 0.2, 20.0, 1.5, 0.2, 20.0, 1.53, 0.2, 20.0),
    (2, 7, 0.08, 0.01, 30.0, 3.0, 0.2, 20.0, None, None, None),  # windows of neighbouring events overlap
    (3, 7, 1.5, 2459000.2, 400.0, 1.5, -70.8, 5.0, 1.5, 0.2, float("nan")),  # far epochs, an event longer than the surroundings
    (4, 8, 1.5, 0.2, 20.0, None, None, None, 1.5, 0.2, 20.0),
    (5, 9, 1.5, 0.2, 20.0, 1.5, 0.2, 20.0, 1.5, 0.2, 20.0),
    (6, 7, None, 0.2, 20.0, 1.5, 0.2, 20.0, 1.5, 0.2, 20.0), (7, 7, 0.0, 0.2, 20.0, 1.5, 0.2, 20.0, 1.5, 0.2, 20.0), (8, 7, 40.0, 30.0, 20.0, 1.5, 0.2, 20.0, 1.5, 0.2, 20.0),
]


@pytest.mark.parametrize("hot", [False, True])
def test_metrics_equal_the_plain_rule(spark, cadences, hot):
    c = spark.createDataFrame(CANDIDATES, SCHEMA)
    got = {r.review_id: r for r in X.two_aperture_metrics(c, spark.createDataFrame(cadences), hot=hot).collect()}
    assert [got[i].metadata_status for i in range(1, 9)] == ["ok"] * 4 + ["missing_target", "no_ephemeris", "no_ephemeris", "ok"]
    checked = 0
    for row in CANDIDATES:
        e = dict(zip(COLS, row))
        for ap, x in X.PREFIXES.items():
            for scope, pre in (("anchor", ""), ("own", f"{x}_")):
                p, t0, dur = (e[f"{pre}{k}"] for k in ("period_d", "t0_bjd", "duration_min"))
                names = ["n_in", "depth", "snr", "even_n_in", "odd_n_in", "even_depth", "odd_depth"]
                g = [getattr(got[row[0]], f"{x}_{scope}_{n}", None) for n in names]
                usable = None not in (p, t0, dur) and p > 0 and np.isfinite(dur) and not (e["tic"] == 8 and ap == "PRI") and e["tic"] != 9
                want = plain(cadences, e["tic"], ap, p, t0, dur) if usable else [0, np.nan, np.nan, 0, 0, np.nan, np.nan]
                for n, a, b in zip(names, g, want):
                    if scope == "own" and n in ("n_in", "depth", "snr"):
                        continue
                    assert (a is None and (b is None or np.isnan(b))) or np.isclose(a, b, rtol=1e-9, atol=1e-12), (row[0], x, scope, n, a, b)
                    checked += 1
    assert checked > 100
    assert got[1].aperture_disagreement is False and np.isclose(got[1].aperture_period_rel_delta, 0.02) or got[1].aperture_disagreement
    assert 0.19 < got[1].small_anchor_depth < 0.21 and np.isclose(got[1].aperture_depth_ratio, 1.0)
    assert got[4].primary_anchor_n_in == 0 and got[4].small_anchor_n_in > 0


def test_enrichment_is_one_to_one(spark, cadences):
    c = spark.createDataFrame(CANDIDATES, SCHEMA).withColumn("small_anchor_depth", F.lit(-5.0)).withColumn("note", F.lit("n"))
    e = X.enrich(c, spark.createDataFrame(cadences))
    rows = e.collect()
    assert len(rows) == len(CANDIDATES) and len(set(e.columns)) == len(e.columns) and all(r.small_anchor_depth != -5.0 and r.note == "n" for r in rows)
    assert {r.metadata_status: r.n for r in X.enrichment_summary(e).collect()} == {"ok": 5, "missing_target": 1, "no_ephemeris": 2}
    with pytest.raises(ValueError):
        X.enrich(c.unionByName(c), spark.createDataFrame(cadences))


def test_near_events_touch_each_cadence_once(spark, cadences):
    c = spark.createDataFrame(CANDIDATES, SCHEMA)
    curves = spark.createDataFrame(cadences).withColumn("y", F.col("flux"))
    near = X.near_events(X.ephemerides(c, ("SML", "PRI")), curves)
    n = near.groupBy("review_id", "scope", "aperture", "time").count()
    assert n.where("count > 1").count() == 0
    # only rows near events are there: 180 of 2,160 minutes
    one = near.where("review_id = 1 AND scope = 'anchor' AND aperture = 'SML'").count()
    assert one < 0.1 * (cadences.tic == 7).sum() / 2


def test_injection_recovery_statuses(spark):
    truth = spark.createDataFrame([(i, 10 + i, 2.0, 0.5, 30.0) for i in range(7)], "injection_id bigint, tic bigint, truth_period_d double, truth_t0_bjd double, truth_duration_min double")
    rows = [
        (0, "SML", 1, 2.001, 0.5, 9.0, "ok"), (0, "PRI", 1, 5.0, 0.1, 12.0, "ok"), (0, "PRI", 2, 2.0, 0.51, 8.0, "ok"),  # top of one aperture
        (1, "SML", 1, 5.0, 0.5, 9.0, "ok"), (1, "SML", 2, 2.0, 0.5, 7.0, "ok"),  # among the top
        (2, "SML", 1, 1.0, 0.5, 9.0, "ok"),  # half the period
        (3, "SML", 1, 2.0, 1.4, 9.0, "ok"),  # right period, wrong epoch
        (4, "SML", 0, None, None, None, "too_few_cadences"), (5, "SML", 1, 2.0, 0.5, float("nan"), "ok"), (5, "SML", 2, 7.0, 0.5, 3.0, "ok"),
    ]
    peaks = spark.createDataFrame([(*r[:5], 30.0, 0.1, 9.0, *r[5:]) for r in rows], "injection_id bigint, aperture string, peak_rank int, period_d double, t0_bjd double, duration_min double, depth double, depth_snr double, sde double, status string")
    got = {r.injection_id: r for r in R.injection_recovery(peaks, truth, ("SML", "PRI")).collect()}
    assert [got[i].topn_recovery_status for i in range(7)] == ["bls_top1_recovered", "bls_topn_recovered", "bls_topn_harmonic_match", "bls_peak_mismatch", "bls_too_few_cadences", "bls_topn_recovered", "bls_missing"]
    assert got[0].rep_aperture == "SML" and got[0].apertures_agree == "SML" and got[0].topn_apertures_agree == "SML,PRI" and got[0].n_topn_apertures_agree == 2
    assert got[2].harmonic_factor_SML == 0.5 and got[1].topn_rank_SML == 2 and got[5].period_d == 7.0


def test_second_search_only_does_what_changed(spark, planted, tmp_path):
    cfg = S.SearchConfig(n_periods=150, durations_min=(20.0,), min_cadences=100, n_peaks=2, p_min_d=1.0)
    base = pd.concat([planted[planted.time < 6].assign(tic=k) for k in (1, 2, 3, 4)], ignore_index=True)
    df, path = spark.createDataFrame(base), str(tmp_path / "run")
    assert R.incremental_search(df, cfg, path, 3) > 0
    first = R.current_peaks(df, cfg, path).toPandas()
    assert set(first.tic) == {1, 2, 3, 4} and len(first) == len(S.search(df, cfg).toPandas())
    assert R.incremental_search(df.repartition(5), cfg, path, 3) == 0
    moved = base.copy()
    moved.loc[(moved.tic == 2) & (moved.aperture == "PRI") & (moved.cadenceno == 50), "flux"] += 0.01
    after = spark.createDataFrame(moved)
    assert R.incremental_search(after, cfg, path, 3) == 1
    stamps = spark.read.parquet(f"{path}/stamps")
    assert stamps.count() == 9  # eight curves, one of them twice
    again = R.current_peaks(after, cfg, path).toPandas()
    same = ["tic", "aperture", "peak_rank", "period_d"]
    rest = lambda d: d[~((d.tic == 2) & (d.aperture == "PRI"))].sort_values(same)[same].reset_index(drop=True)
    pd.testing.assert_frame_equal(rest(again), rest(first))
    # peaks of a run that was stopped before its stamp are not read
    spark.read.parquet(f"{path}/peaks").where("tic = 1").drop("batch").write.parquet(f"{path}/peaks/batch=stopped")
    assert len(R.current_peaks(after, cfg, path).toPandas()) == len(again)
    assert R.incremental_search(after, S.SearchConfig(**{**cfg.__dict__, "n_peaks": 1}), path, 3) > 0  # other settings are other work


def test_tied_ranks_have_one_rule_in_query_and_sql(spark, tmp_path):
    import duckdb
    import __spark_entry__ as entry
    li = pd.DataFrame([(469360, 74179, 3922, 3, 10.0, 60966.11, "O"), (469360, 65986, 3738, 3, 13.0, 54938.03, "O"), (469360, 70879, 3752, 2, 33.0, 6858.48, "F"),
                       (7, 12, 1, 1, 3.0, 500.0, "F"), (7, 13, 2, 1, 4.0, 500.0, "F"), (7, 13, 2, 1, 5.0, 500.0, "F")],
                      columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus"]).assign(l_discount=0.05).astype({"l_linenumber": "int32"})
    orders = pd.DataFrame({"o_orderkey": [469360, 7], "o_custkey": [1, 2], "o_totalprice": [10.0, 20.0], "o_orderpriority": "x"})
    want = None
    for k, rows in enumerate((li, li[::-1])):
        d = tmp_path / str(k)
        d.mkdir()
        rows.to_parquet(d / "lineitem.parquet", index=False)
        orders.to_parquet(d / "orders.parquet", index=False)
        con = duckdb.connect()
        for t in ("lineitem", "orders"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
        cur = con.execute(entry.oracle_sql()["injection_search"])
        cols = [c[0] for c in cur.description]
        sql = sorted(map(str, cur.fetchall()))
        assert sql == sorted(map(str, map(tuple, entry.queries()["injection_search"](spark, str(d)).select(*cols).collect()))) and sql == (want or sql)
        want = sql
