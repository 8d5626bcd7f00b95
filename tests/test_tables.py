import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumensift.functions import exprs as E, hashing as H, sql as Q
from lumensift.operators import align as A, gates as G, labels as L, metrics as M, models as D, recovery as R, select as S, splits as P
from lumensift.sources import sinks, tables as T
from lumensift.streaming import streams


def test_stable_fold_uses_all_64_bits(spark):
    got = {r["id"]: r["f"] for r in spark.range(200).select("id", H.stable_fold(F.col("id"), 9, 5).alias("f")).collect()}
    for k, f in got.items():
        assert f == int.from_bytes(hashlib.sha256(f"9|{k}".encode()).digest()[:8], "big") % 5


def test_roles_are_exact_per_cell(spark):
    d = spark.range(2500 * 8).select(F.col("id").alias("injection_id"), (F.col("id") % 2500).alias("cell"))
    g = P.rank_in_cell_roles(d, "cell", "injection_id", 1).groupBy("cell").agg(F.count_if(F.col("partition") == "locked_holdout").alias("h"), F.count(F.lit(1)).alias("n"))
    assert g.where("h <> 2 OR n <> 8").count() == 0


def test_groups_and_targets_never_split(spark):
    d = spark.range(3000).select(F.col("id"), (F.col("id") % 400).alias("tic"), F.when(F.col("id") % 400 < 20, "rare").otherwise("common").alias("label"))
    f = P.grouped_folds(d, "tic", "label", 5, 3)
    assert f.groupBy("tic").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    per = [r["count"] for r in f.where("label = 'rare'").select("tic", "fold").distinct().groupBy("fold").count().collect()]
    assert sorted(per) == [4] * 5
    s = P.disjoint_splits(d, "tic", 0.2, 0.2, 4)
    assert s.groupBy("tic").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(ValueError):
        P.union_registry([("a", d), ("b", d)], disjoint=[("a", "b")])
    with pytest.raises(ValueError):
        P.require_minimum(d, 401)


def test_repeats_are_far_apart_and_positions_unique(spark):
    u = spark.range(400).withColumnRenamed("id", "review_id")
    p = S.place_repeats(u, u.where("review_id < 20"), 5, "review_id").toPandas()
    assert sorted(p["display"]) == list(range(420))
    d = p[p["occurrence"] != "single"].groupby("review_id")["display"].agg(lambda v: v.max() - v.min())
    assert len(d) == 20 and (d >= 100).all()


def test_quota_buckets_are_unique_and_exact(spark):
    d = spark.range(600).select(F.col("id").alias("review_id"), (F.col("id") % 200).alias("tic"), (F.col("id") * 7 % 101).cast("double").alias("s"))
    q = S.quota_buckets(d, [S.Bucket("a", 30, score="s"), S.Bucket("b", 20, "s < 10"), S.Bucket("c", 25)], 1, excluded=d.where("tic < 5"))
    r = q.toPandas()
    assert r["tic"].is_unique and len(r) == 75 and r["tic"].min() >= 5 and (r["bucket"] == "a").sum() == 30
    assert S.allocation({"x": 100, "y": 3, "z": 50}, 60, ["y"], 10, 5) and sum(S.allocation({"x": 100, "y": 3, "z": 50}, 60, ["y"], 10, 5).values()) == 60


def test_threshold_never_passes_the_budget_with_ties(spark):
    s = [0.9] * 3 + [0.8] * 5 + [0.1] * 92
    d = spark.createDataFrame([(i, v) for i, v in enumerate(s)], "tic int, p double")
    r = M.workload_threshold(d, "p", 0.05).first()
    assert r["max_pass"] == 5 and r["n_pass"] == 3 and r["threshold"] == 0.9


def test_ranking_metrics_match_pairs(spark):
    rng = np.random.default_rng(4)
    p, y = np.round(rng.uniform(size=300), 2), rng.uniform(size=300) < 0.3
    d = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    want = (p[y][:, None] > p[~y][None, :]).mean() + 0.5 * (p[y][:, None] == p[~y][None, :]).mean()
    got = M.ranking_metrics(M.score_levels(d, "p", F.col("y"))).first()
    assert np.isclose(got["roc_auc"], want)
    spark.conf.set("lumensift.hotGroupRows", "10")
    try:
        again = M.ranking_metrics(M.score_levels(d, "p", F.col("y"), n_buckets=7)).first()
    finally:
        spark.conf.unset("lumensift.hotGroupRows")
    assert np.allclose(list(again), list(got))


def test_ranker_beats_raw_rank_and_round_trips(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(80):
        true = 4 if i < 72 else 2
        for k in range(1, 6):
            sig = k == true
            rows.append((i, k, 1.0 + rng.uniform(), 12.0, 0.05, 20.0 + rng.normal() if sig else 8.0 + rng.normal(), 15.0 - k, 1.0, sig))
    d = spark.createDataFrame(rows, "injection_id int, peak_rank int, period_d double, duration_min double, depth double, depth_snr double, sde double, log_power double, is_signal boolean")
    m = D.train_peak_ranker(d)
    s = D.rank_with(m, d)
    raw = R.recall_at_k(s, (1,)).first()["n"]
    new = R.recall_at_k(s, (1,), [-F.col("p_signal"), F.col("peak_rank")]).first()["n"]
    assert new > raw and new >= 75
    m.save(str(tmp_path / "m"))
    again = D.rank_with(D.Classifier.load(spark, str(tmp_path / "m")), d)
    a, b = (x.orderBy("injection_id", "peak_rank").toPandas()["p_signal"] for x in (s, again))
    assert np.allclose(a, b)
    with pytest.raises(ValueError):
        D.assert_no_leakage(["period_d", "truth_depth"])


def test_recall_handles_ids_without_signal(spark):
    d = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (3, 1, True)], "injection_id int, peak_rank int, is_signal boolean")
    r = {x["k"]: x for x in R.recall_at_k(d, (1, 2)).collect()}
    assert (r[1]["n"], r[2]["n"], r[1]["denom"], r[1]["rankable"]) == (1, 2, 3, 2)


def test_missing_evidence_fails(spark):
    d = spark.createDataFrame([(None,), (float("nan"),), (0.5,)], "v double")
    assert [r[0] for r in d.select(E.status_max("v", 1.0, 2.0)).collect()] == ["fail", "fail", "pass"]
    assert G.compose([spark.createDataFrame([], "gate string, status string")]).first()["status"] == "fail"
    t = spark.createDataFrame([(1,)], "tic bigint")
    e = lambda s: spark.createDataFrame([], s)
    f = G.target_flags(t, e("tic bigint, missing_fraction double"), e("tic bigint, finite_q0_fraction double"), e("tic bigint, mad_ratio double")).first()
    assert f["status"] == "fail"


def test_content_hash_ignores_order_and_sees_changes(spark):
    a = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    h = lambda d: G.content_hash(d, ["id", "v"]).first()["content_sha256"]
    assert h(a) == h(a.orderBy(F.desc("id")).repartition(7)) and h(a) != h(a.where("id < 99"))


def test_reconciliation_errors(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "cadenceno int, orbitid int")
    b = spark.createDataFrame([(2, 1), (3, 1)], "cadenceno int, orbitid int")
    st = A.reconcile(a, b, ["cadenceno"])
    assert {r["cadenceno"]: r["state"] for r in st.collect()} == {1: "left_only", 2: "both", 3: "right_only"}
    with pytest.raises(ValueError):
        A.require_reconciled(st, ["cadenceno"])


def test_nearest_time_prefers_earlier_on_ties_and_hot_equals_plain(spark):
    l = spark.createDataFrame([(1, 1.0, 10), (1, 5.2, 11)], "k int, time double, a int")
    r = spark.createDataFrame([(1, 0.5, 1), (1, 1.5, 2), (1, 5.0, 3)], "k int, time double, b int")
    for hot in (False, True):
        got = {x["a"]: x["match_b"] for x in A.nearest_time(l, r, ["k"], ["a"], ["b"], hot=hot).collect()}
        assert got == {10: 1, 11: 3}


def test_notes_and_buttons(spark):
    d = spark.createDataFrame([("half-period",), ("P / 3",), ("2.5 p",), ("twice the period",), ("fine",), (None,)], "n string")
    got = [r[0] for r in d.select(E.note_period_factor("n")).collect()]
    assert got[0] == 0.5 and np.isclose(got[1], 1 / 3) and got[2] == 2.5 and got[3] == 2.0 and got[4] is None and got[5] is None
    n = spark.createDataFrame([("half of the period",), ("halfperiod",), ("refold to p/2",), ("2p",), ("twice period",), ("wrong fold",), ("",)], "n string").select(E.note_refold("n").alias("r")).select("r.*").collect()
    assert [r["factor"] for r in n] == [0.5, 0.5, 0.5, 2.0, 2.0, None, None] and [r["suspect"] for r in n] == [True] * 6 + [False]
    values = [1.23456789012345, 2.0, 1e-7, -0.000123456789, 123456789.123456789, 1e15, 1.5e120, 0.1, 100.0, 2457000.4, -3e-5]
    k = spark.createDataFrame([(v,) for v in values], "v double").select(E.number_text("v").alias("t")).collect()
    assert [r["t"] for r in k] == [format(v, ".15g") for v in values]
    b = spark.createDataFrame([("0.250",), ("?",), ("",), ("7",)], "t string").select(E.button_factor("t").alias("b")).select("b.*").collect()
    assert [r["factor_text"] for r in b] == ["0.25", "unresolved", "1", None]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "p" / "x").mkdir(parents=True)
    for n in ("tag_s0056-0000000000000042_o119_cam1_ccd2.fits", "tag_s0057-0000000000000043_o121_cam1_ccd2.fits"):
        (tmp_path / "p" / "x" / n).write_bytes(b"1234")
    inv = T.sector_files(spark, str(tmp_path / "p"), 56).collect()
    assert len(inv) == 1 and inv[0]["tic"] == 42 and inv[0]["length"] == 4 and inv[0]["orbit"] == 119
    (tmp_path / "log.csv").write_text("row_id,label,updated_utc\n1,a,2024-01-02T00:00:00\n1,b,\nx,c,\n1,d,2024-01-03T00:00:00\n")
    log = T.read_label_log(spark, str(tmp_path / "log.csv"))
    assert L.latest_labels(log).select("row_id", "label").collect() == [(1, "d")]
    (tmp_path / "f.txt").write_text("# head\n1 0\n2 4\n2 4\n")
    with pytest.raises(ValueError):
        T.read_flag_file(spark, str(tmp_path / "f.txt"))
    (tmp_path / "i.txt").write_text("12 # comment\n/a/b/s0056-0012.fits\n99\n# none\n")
    assert sorted(r["tic"] for r in T.read_include_list(spark, str(tmp_path / "i.txt")).collect()) == [12, 99]
    d = spark.range(50).select(F.col("id").alias("k"), (F.col("id") / 3).alias("v"))
    sinks.write_versioned(d, str(tmp_path / "v1"), "1", ["k", "v"])
    assert spark.read.text(str(tmp_path / "v1" / "manifest")).count() == 1
    with pytest.raises(Exception):
        sinks.write_versioned(d, str(tmp_path / "v1"), "1", ["k", "v"])
    parts = [d.where("k < 20"), d.where("k >= 20")]
    assert sinks.merge_shards(parts, d, ["k"]).count() == 50
    with pytest.raises(ValueError):
        sinks.merge_shards(parts[:1], d, ["k"])
    with pytest.raises(ValueError):
        sinks.write_blinded(d, d, str(tmp_path / "b"), ["v"])
    with pytest.raises(ValueError):
        T.read_table(spark, "x.csv")
    sinks.strict_json(spark.createDataFrame([(1, float("nan"))], "b int, a double"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":1}'
    pk = sinks.peak_table(spark.createDataFrame([(1, 1.5)], "tic bigint, period_d double"))
    assert len(pk.columns) == 38


def test_label_stream_equals_batch_over_many_files(spark, tmp_path):
    rows = [(i % 7, f"l{i}", None if i % 5 == 0 else f"2024-01-01 00:{i * 13 % 60:02d}:00", i) for i in range(40)]
    d = spark.createDataFrame(rows, "row_id bigint, label string, u string, seq bigint").select("row_id", "label", F.to_timestamp("u").alias("updated_utc"), "seq")
    for i in range(4):
        d.where(F.col("seq") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = streams.latest_label_stream(s, ttl_ms=None).writeStream.outputMode("update").foreachBatch(streams.merge_latest(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(streams.as_of(spark.read.parquet(out)).select("row_id", "label").collect())
    assert got == sorted(L.latest_labels(d).select("row_id", "label").collect())


def test_sql_functions_and_table_function(spark, planted):
    names = Q.register(spark)
    assert "box_periodogram" in names
    assert abs(spark.sql("SELECT phase_days(1.6D, 1.5D, 0.2D) AS p").first()["p"] - (-0.1)) < 1e-12
    t = planted[planted["aperture"] == "SML"]
    spark.createDataFrame(pd.DataFrame({"tic": 7, "aperture": "SML", "time": t["time"], "y": t["flux"] / t["flux"].median()})).createOrReplaceTempView("one_curve")
    top = spark.sql("SELECT * FROM box_periodogram(TABLE(SELECT * FROM one_curve) PARTITION BY (tic, aperture)) ORDER BY power DESC LIMIT 1").first()
    ratio = top["period_d"] / 1.5
    assert min(abs(ratio - f) for f in (0.5, 1, 2)) < 0.01


@pytest.mark.parametrize("baseline", [3.0, 30.0, 300.0])
def test_no_period_falls_between_trial_frequencies(baseline):
    f = Q.trial_frequencies(min(0.45 * baseline, 15.0), 0.12, baseline, 3 / 1440)
    assert np.isclose(f[0], 1 / min(0.45 * baseline, 15.0)) and np.isclose(f[-1], 1 / 0.12)
    assert (np.diff(f) * baseline <= 3 / 1440 * f[1:]).all()  # cycles of drift against the box as a share of the period


def test_repeat_agreement(spark):
    d = spark.createDataFrame([(1, "original", "a", "1"), (1, "blind_repeat", "a", "1"), (2, "original", "a", "1"), (2, "blind_repeat", "b", "1")], "repeat_group int, occurrence string, label string, factor string")
    k = L.agreement(L.repeat_pairs(d)).first()
    assert k["n_pairs"] == 2 and k["observed"] == 0.5 and np.isclose(k["expected"], 0.5) and np.isclose(k["kappa"], 0.0)


def test_table_streams_read_files_and_folders(spark, tmp_path):
    from lumensift.plans.scalar_queries import stream_latest_labels
    src = "/root/testdata/sf0.001"
    spark.read.parquet(f"{src}/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    one, many = (sorted(stream_latest_labels(spark, d).collect()) for d in (src, str(tmp_path)))
    assert one and one == many


def test_peak_features_share_one_exchange(spark):
    x = F.col("id")
    p = spark.range(4000).select((x % 700).alias("g"), (x % 7).alias("peak_rank"), (x % 13 / 10.0).alias("depth"), F.when(x % 9 != 0, x % 17 / 2.0).alias("sde"), (x % 19 / 3.0).alias("depth_snr"),
                                 (x % 23 / 5.0).alias("log_power"), F.lit(1.5).alias("period_d"), F.lit(20.0).alias("duration_min"))
    windows = D.peak_features(p, "g")
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    counted = D.peak_features(p, "g", hot=True).select(*windows.columns)
    assert windows.exceptAll(counted).isEmpty() and counted.exceptAll(windows).isEmpty()


def test_selection_score_joins_truth_once(spark):
    from lumensift.plans.gate_queries import model_selection_score
    s = model_selection_score(spark, "/root/testdata/sf0.001")
    assert "FileScan" not in s._jdf.queryExecution().executedPlan().toString()
    assert {x["profile"] for x in s.collect() if x["selection_score"] > 0} == {"sde", "depth_snr"}


def test_group_ranks_are_dealt_by_counted_rows(spark, monkeypatch):
    p = spark.range(900).selectExpr("id % 300 AS g", "double(id % 7 + 1) AS sde", "double(id % 5) - 2 AS depth", "1.5D AS period_d")
    want = sorted(map(str, D.peak_features(p, "g", hot=False).collect()))
    monkeypatch.setattr(D, "TASK_ROWS", 30)
    d = D.peak_features(p, "g")
    assert d.rdd.getNumPartitions() == 30
    assert sorted(map(str, d.collect())) == want
    exchange = next(s for s in d._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in s)
    below = d._jdf.queryExecution().optimizedPlan().toString().split(exchange)[1]
    assert "log10" not in below.lower()  # narrow rows are shuffled
