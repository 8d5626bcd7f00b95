import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumensift.operators import inject, ordered, ordering, robust, skew, splits, views


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    k = np.repeat([1, 2, 3], [4000, 51, 1])
    v = np.concatenate([rng.normal(0, 1, 3990), np.repeat(5.0, 10), rng.lognormal(0, 3, 51), [2.0]])
    v[5] = np.nan
    pdf = pd.DataFrame({"k": k, "v": v, "id": np.arange(k.size)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_narrowed_quantiles_equal_numpy_and_direct(values):
    pdf, df = values
    probs = {"a": 0.1, "b": 0.5, "c": 0.68}
    direct = {r["k"]: r for r in robust.grouped_quantiles(df, ["k"], F.col("v"), probs).collect()}
    hot = {r["k"]: r for r in robust.grouped_quantiles(df, ["k"], F.col("v"), probs, hot=True, bins=8, rounds=2).collect()}
    for k, part in pdf.groupby("k"):
        want = np.nanquantile(part["v"], list(probs.values()))
        for got in (direct[k], hot[k]):
            assert np.allclose([got["a"], got["b"], got["c"]], want, rtol=1e-12)


def test_hot_scales_equal_direct(values):
    _, df = values
    a = sorted(map(tuple, robust.robust_scales(df, ["k"], F.col("v")).collect()))
    b = sorted(map(tuple, robust.robust_scales(df, ["k"], F.col("v"), hot=True).collect()))
    assert np.allclose(np.array(a, float), np.array(b, float))
    a = sorted(map(tuple, robust.clipped_rms(df, ["k"], F.col("v"), 3.0, 1).collect()))
    b = sorted(map(tuple, robust.clipped_rms(df, ["k"], F.col("v"), 3.0, 1, hot=True).collect()))
    assert np.allclose(np.array(a, float), np.array(b, float))


def test_hot_group_check(values):
    _, df = values
    assert skew.has_hot_group(df, ["k"], 3999)
    assert not skew.has_hot_group(df, ["k"], 4000)
    assert [r["k"] for r in skew.hot_groups(df, ["k"], 100).collect()] == [1]
    with pytest.raises(ValueError):
        skew.assert_unique(df, ["k"])


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    t = np.sort(np.concatenate([rng.uniform(0, 3, 200), rng.uniform(4.5, 6, 100), [2.0, 2.0]]))
    pdf = pd.DataFrame({"k": 1, "time": t, "id": np.arange(t.size), "v": rng.normal(size=t.size)})
    pdf.loc[::7, "v"] = np.nan
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(3)


def same(a, b, *cols):
    f = lambda d: sorted(d.select("id", *cols).collect())
    assert f(a) == f(b)


def test_chunked_steps_equal_windows(walk):
    o = ["time", "id"]
    same(*[ordered.with_previous(walk, ["k"], o, {"p": F.col("v"), "pt": F.col("time")}, hot=h) for h in (False, True)], "p", "pt")
    same(*[ordered.with_running_sum(walk, ["k"], o, F.col("id"), "s", hot=h) for h in (False, True)], "s")
    same(*[ordered.with_row_index(walk, ["k"], o, "i", hot=h) for h in (False, True)], "i")
    same(*[ordered.with_neighbours(walk, ["k"], o, F.col("v"), "b", "a", hot=h) for h in (False, True)], "b", "a")
    same(*[ordered.with_gap_segments(walk, ["k"], "time", "id", 0.5, hot=h) for h in (False, True)], "segment")
    same(ordered.with_running_median(walk, ["k"], o, F.col("v"), "m", 4), ordered.with_running_median(walk, ["k"], o, F.col("v"), "m", 4, hot=True, block=16), "m")


def test_global_rank_of_large_tables_equals_window(spark):
    d = spark.range(5000).select("id", (F.col("id") % 3).cast("double").alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(6)
    o = [-F.col("s"), F.col("h")]
    same(ordering.with_global_row_number(d, o, "n"), ordering.with_global_row_number(d, o, "n", limit=100, n_splits=16), "n")
    b = ordering.rank_bins(d, o, 4, "q", limit=100).groupBy("q").count().collect()
    assert sorted(r["count"] for r in b) == [1250] * 4


def test_global_order_cuts_at_nested_and_missing_keys(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 7919 % 97 / 4.0).alias("x"), F.struct(F.when(F.col("id") % 3 != 0, F.col("id") % 11).alias("a"), F.struct(F.col("id").alias("b")).alias("c")).alias("tie"))
    o = [F.col("x"), F.col("tie")]
    same(ordering.with_global_row_number(d, o, "n"), ordering.with_global_row_number(d, o, "n", limit=100, n_splits=60), "n")


def test_cells_without_capacity_take_all_hosts(spark):
    hosts = spark.range(50).select(F.col("id").alias("tic"), (F.col("id") % 3).alias("s"))
    got = splits.deal_to_cells(hosts, "s", 4, None, "tic", 1).collect()
    assert len({(r["grid_cell_index"], r["grid_slot"]) for r in got}) == len({r["injection_index"] for r in got}) == 50 and max(r["grid_slot"] for r in got) == 12
    with pytest.raises(ValueError):
        splits.deal_to_cells(hosts, "s", 4, 12, "tic", 1)


@pytest.mark.parametrize("n_cells", [3, 10])
def test_host_schedule_takes_bright_hosts_first_without_a_gathered_limit(spark, n_cells):
    from lumensift.functions.hashing import digest
    hosts = spark.range(40).select(F.col("id").alias("tic"), F.when(F.col("id") % 4 == 0, 17.0).otherwise(20.0).alias("tmag"), (F.col("id") != 5).alias("host_ok"))
    spark.conf.set("lumensift.hotGroupRows", "10")  # tables beyond one window
    try:
        d = inject.host_schedule(hosts, spark.createDataFrame([(6,)], "tic long"), n_cells, 4, 2, 9)
    finally:
        spark.conf.unset("lumensift.hotGroupRows")
    assert "GlobalLimit" not in d._jdf.queryExecution().optimizedPlan().toString()
    order = hosts.where("tic NOT IN (5, 6)").orderBy(F.col("tmag") >= 19, digest(F.col("tic"), 9), "tic").select("tic").collect()
    assert {r["tic"] for r in d.collect()} == {r["tic"] for r in order[:n_cells * 4]} and d.count() == min(38, n_cells * 4)


def test_hot_plans_keep_rows_without_time_or_key(spark):
    rows = [(1, None, 1, 1.0), (1, float("nan"), 2, 2.0), (None, 0.3, 3, 3.0), (None, None, 4, None)] + [(1, i * 0.2, 10 + i, float(i)) for i in range(12)]
    d = spark.createDataFrame(rows, "k int, time double, i int, v double")
    f = lambda x: sorted(map(str, x.collect()))
    for step in (lambda h: ordered.with_previous(d, ["k"], ["time", "i"], {"p": F.col("v")}, hot=h), lambda h: ordered.with_running_sum(d, ["k"], ["time", "i"], F.col("v"), "s", hot=h),
                 lambda h: ordered.with_neighbours(d, ["k"], ["time", "i"], F.col("v"), "b", "a", hot=h), lambda h: ordered.with_row_index(d, ["k"], ["time", "i"], hot=h),
                 lambda h: ordered.with_gap_segments(d, ["k"], "time", "i", 0.15, hot=h)):
        assert f(step(False)) == f(step(True))


def test_column_quantiles_of_large_tables_are_exact(spark):
    d = spark.range(30000).select((F.rand(3) * 10).alias("a"), F.when(F.col("id") % 7 == 0, F.floor(F.rand(4) * 5)).cast("double").alias("ties"), F.lit(None).cast("double").alias("none"),
                                  F.when(F.col("id") < 29999, F.lit(1.0)).otherwise(F.lit(float("nan"))).alias("flat"), F.when(F.col("id") == 5, 7.5).alias("one")).localCheckpoint()
    for p in (0.0, 0.5, 0.9, 1.0):
        assert robust.column_quantiles(d, d.columns, p, limit=10) == robust.column_quantiles(d, d.columns, p)


def test_level_quantiles_equal_percentiles(spark):
    d = spark.range(20000).select(F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("k"), F.floor(F.rand(5) * 400).cast("double").alias("v"))
    got = {x["_key"]: (x["a"], x["b"]) for x in robust.level_quantiles(d.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")), "k", "v", "n", {"a": 0.5, "b": 0.9}, 7).collect()}
    want = {x["k"]: (x["a"], x["b"]) for x in d.groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.9).alias("b")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_aperture_quantiles_hold_no_group_in_one_task(spark):
    from lumensift.operators import recovery
    d = spark.range(500).select((F.col("id") % 90).alias("tic"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("ap"), (F.col("id") * 37 % 101 / 7).alias("snr"))
    s = recovery.best_of_group(d, ["tic"], "ap", "snr", 7.0)
    assert "percentile" not in s._jdf.queryExecution().optimizedPlan().toString()
    assert {x["aperture"]: x["n"] for x in s.collect()} == {"a": 250, "b": 250, "*": 90}


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_folds_are_dealt_by_candidate_once(spark):
    j = spark.range(600).select((F.col("id") % 3).alias("review_id"), F.when(F.col("id") % 2 == 0, "SML").otherwise("PRI").alias("aperture"), (F.floor(F.col("id") / 6) / 10).alias("time"), F.floor(F.col("id") / 6).alias("cadenceno"),
                                (1 + F.col("id") % 11 / 100).alias("flux"), F.lit(2.0).alias("period_d"), F.lit(1.0).alias("t0_bjd"), F.lit(300.0).alias("duration_min"))
    t = views.thinned_fold(j, 6, 4.0)
    assert exchanges(t) == 1
    assert t.groupBy("review_id", "view").agg(F.count(F.lit(1)).alias("n"), F.max("n_all").alias("a")).where("n <> least(a, 6)").isEmpty()
    plan = views.folded_bins(j, 16, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(review_id" in plan
    assert not any("flux" in line for line in plan.splitlines() if "hashpartitioning(review_id" in line and "aperture" in line.split("hashpartitioning")[1])


def test_attempts_are_a_bounded_top_k(spark):
    from lumensift.operators import select
    hosts = spark.range(500).select(F.col("id").alias("tic"))
    c = select.host_cycles(hosts, 30, 7)
    assert "TakeOrderedAndProject" in c._jdf.queryExecution().executedPlan().toString()
    assert sorted(x["attempt"] for x in c.collect()) == list(range(1, 31))
    assert select.host_cycles(hosts, 1200, 7).groupBy("tic").count().agg(F.min("count"), F.max("count")).first() == (2, 3)


def test_coverage_counts_distinct_values_without_copies(spark):
    from lumensift.operators import catalog
    o = spark.createDataFrame([(1, 5, 9), (1, 5, 10), (1, None, 10), (2, None, None)], "catalog_row int, sector int, orbit int").select(
        "*", F.lit(1).alias("camera"), F.lit(1).alias("ccd"), F.lit(1.5).alias("colpix"), F.lit(2.5).alias("rowpix"), F.lit(False).alias("edge_warn"))
    p = catalog.coverage_payload(o)
    assert "Expand" not in p._jdf.queryExecution().executedPlan().toString()
    assert {x["catalog_row"]: (x["n_observations"], x["n_sectors"], x["n_orbits"]) for x in p.collect()} == {1: (3, 1, 2), 2: (1, 0, 0)}


def test_inputs_of_global_order_are_written_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(x):
        made.add(1)
        return x

    ids = spark.range(300).select(seen("id").alias("k"))
    assert splits.disjoint_splits(ids.distinct(), "k", 0.2, 0.2, 3).count() == 300
    assert made.value <= 900  # the ids once; the rows, and the filter of their join, once more for their splits
    made.value = 0
    assert ordering.rank_bins(ids, [F.col("k")], 4, "b", limit=10).count() == 300
    assert made.value == 300
