import pytest
from pyspark.sql import functions as F

from lumensift.operators import review_tables as T


def test_display_takes_only_whole_anchors_of_the_last_table(spark):
    q = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", None), (None, 3.0)], "review_id string, period_d double").withColumns({"t0_bjd": F.lit(5.0), "duration_min": F.lit(10.0)})
    m = spark.createDataFrame([("a", 2.0, 6.0, 20.0), ("b", 4.0, 6.0, 20.0), ("c", float("nan"), 6.0, 20.0), (None, 9.0, 9.0, 9.0)], "review_id string, anchor_period_d double, anchor_t0_bjd double, anchor_duration_min double")
    last = spark.createDataFrame([("b", 7.0)], "review_id string, anchor_period_d double")
    got = {r.review_id: (r.display_period_d, r.display_source, r.display_period_rel_delta) for r in T.display_ephemeris(q, [m, last]).collect()}
    assert got == {"a": (2.0, "anchor", 1.0), "b": (0.0, "queue", None), "c": (None, "queue", None), None: (3.0, "queue", 0.0)}
    assert {r.display_source for r in T.display_ephemeris(q).collect()} == {"queue"}


def test_features_join_on_all_shared_keys_and_never_multiply(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "row_id int, review_id string")
    m = spark.createDataFrame([(1, "a", 0.1), (2, "a", 0.2)], "row_id int, review_id string, x double")
    s = spark.createDataFrame([("a", 5)], "review_id string, shape int")
    got = sorted(tuple(r) for r in T.assemble_features(t, s, [m, m.where("row_id = 2").withColumn("x", F.lit(0.9))]).select("row_id", "x", "shape").collect())
    assert got == [(1, 0.1, 5), (2, 0.9, 5), (3, None, None)]
    with pytest.raises(KeyError):
        T.assemble_features(t, s.withColumnRenamed("review_id", "other"))
    with pytest.raises(ValueError):
        T.assemble_features(t, s.union(s))


def test_diagnostics_bins_and_classes(spark):
    q = spark.createDataFrame([(1, "bls_recovered", 16.0), (2, "none", 16.5), (3, None, None), (4, "none", 30.0)], "injection_id int, recovery_mode string, tmag double")
    s = spark.createDataFrame([(1, "S", 1.0), (2, "S", 7.0), (3, "P", 9.0), (4, "S", 6.9)], "injection_id int, aperture string, snr double")
    got = {r.injection_id: (r.failure_class, r.snr_bin, r.tmag_bin, r.radius_rearth_bin) for r in T.joined_diagnostics(q, s, "S").collect()}
    assert got == {1: ("matched_top1", 0, 0, None), 2: ("snr_qualified_ranking_loss", 3, 1, None), 3: ("unknown_or_missing_snr", None, None, None), 4: ("low_snr_unmatched", 3, 5, None)}
    with pytest.raises(ValueError):
        T.joined_diagnostics(q, s.union(s), "S")


def test_scored_transfer_refuses_lost_rows(spark):
    rows = spark.createDataFrame([(1, 1, "x", "yes"), (2, 1, "other", "yes"), (3, 1, "x", "no")], "tic int, peak_rank int, human_label string, scoring_eligible string")
    s = spark.createDataFrame([(1, 1, 0.5, 0.5), (2, 1, 0.1, 0.9)], "tic int, peak_rank int, p_a double, p_b double")
    assert [(r.tic, r.target, r.predicted) for r in T.scored_transfer(rows, s, ("a", "b"), {"x": "b"}).collect()] == [(1, "b", "a")]
    for bad in (s.where("tic = 1"), s.withColumn("p_a", F.lit(float("nan"))), s.union(s)):
        with pytest.raises(ValueError):
            T.scored_transfer(rows, bad, ("a", "b"), {"x": "b"})


def test_gate_needs_every_aperture(spark):
    p = spark.createDataFrame([(1, "S", 1, 2.0, 10.0, 12.0), (1, "S", 1, 9.0, 10.0, 11.0), (1, "P", 2, 2.0, 10.0, 12.0)], "tic int, aperture string, peak_rank int, period_d double, t0_bjd double, sde double")
    got = {r.aperture: (r.passed, r.reason, r.gate_passed) for r in T.both_aperture_gate(p, 1, 2.001, 10.0, ("S", "P")).collect()}
    assert got == {"S": (True, "", False), "P": (False, "missing_top1", False)}
    both = p.where("peak_rank = 1").unionByName(p.where("peak_rank = 2").withColumn("peak_rank", F.lit(1)))
    assert {r.gate_passed for r in T.both_aperture_gate(both, 1, 2.001, 10.0, ("S", "P")).collect()} == {True}
    assert {r.passed for r in T.both_aperture_gate(both.limit(0), 1, 2.0, 10.0, ("S", "P")).collect()} == {False}


def test_merged_orbits_keep_every_row_in_both_plans(spark):
    raw = spark.createDataFrame([(1, 2, 5, 3.0), (1, 1, 9, 3.0), (1, 1, 4, 3.0), (1, 1, 3, 1.0), (2, 1, 1, None)], "tic int, orbit int, cadenceno int, time double")
    for hot in (False, True):
        got = {(r.tic, r.orbitid, r.cadenceno): r.row_idx for r in T.merge_orbits(raw, hot=hot).collect()}
        assert got == {(1, 1, 3): 0, (1, 1, 4): 1, (1, 1, 9): 2, (1, 2, 5): 3, (2, 1, 1): 0}


def test_training_table_splits_only_strong_labels(spark):
    q = spark.range(60).select(F.col("id").cast("string").alias("review_id"), F.lit("real").alias("source_kind"))
    lab = q.select("review_id", F.when(F.col("review_id") < "3", "planet_like").when(F.col("review_id") < "4", "uncertain").otherwise("skip").alias("label"))
    out = T.human_training_table(q, lab.where("review_id <> '0'"), None, [], 1).toPandas()
    strong = out[out.human_label == "planet_like"]
    assert set(strong.training_split) == {"train", "validation", "test"} and set(out[out.human_label != "planet_like"].training_split) == {"unlabeled_or_audit"}
    assert len(out) == 60 and not out[out.human_label == "skip"].audit_include.any() and out[out.human_label == "uncertain"].audit_include.all()
