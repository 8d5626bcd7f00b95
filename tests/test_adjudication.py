import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumensift.operators import adjudication as A, ordered as O, views as V

EVENTS = "source_uid string, slot string, at double, pass_no int, seq bigint, label string, factor string"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def manifest(spark, sizes):
    rows = [(u, "original" if i == 0 else "blind_repeat", f"g{u}", 2.0) for u, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "source_uid string, occurrence string, repeat_group string, review_period_d double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


LOG = [
    ("pair", "original", 1.0, 1, 0, "planet_like", "1"), ("pair", "blind_repeat", 2.0, 1, 1, "uncertain", "1"), ("pair", "resolution", 3.0, 2, 0, "skip", "2"),
    ("pair", "resolution", 4.0, 2, 1, "", "1"), ("pair", "blind_repeat", 5.0, 1, 2, "planet_like", "1"),
    ("one", "original", None, 1, 3, "skip", "1"), ("one", "original", 1.0, 1, 4, "planet_like", "0.5"), ("one", "original", None, 1, 9, "", "1"),
    ("factor", "original", 1.0, 1, 5, "planet_like", "1"), ("factor", "blind_repeat", 1.0, 1, 6, "planet_like", "unresolved"),
]
SIZES = {"pair": 2, "one": 1, "factor": 2, "silent": 2}


@pytest.mark.parametrize("hot", [False, True])
def test_replay_walks_through_the_states(spark, hot):
    r = A.replay(events(spark, LOG), manifest(spark, SIZES), hot).where("source_uid = 'pair'").orderBy("at").collect()
    assert [x.state for x in r] == ["half_reviewed", "discordant", "third_pass_resolution", "discordant", "blind_repeat_agreement"]


def test_replay_ends_in_the_folded_state(spark):
    e, m = events(spark, LOG), manifest(spark, SIZES)
    last = A.replay(e, m).groupBy("source_uid").agg(F.max_by("state", F.struct("at", "pass_no", "seq")).alias("state"))
    now = A.decisions(m, A.fold(e)).where("n_events > 0").select("source_uid", "state")
    assert rows(last) == rows(now)


def test_any_prefix_and_any_order_give_the_same_state(spark):
    m, whole = manifest(spark, SIZES), rows(A.decisions(manifest(spark, SIZES), A.fold(events(spark, LOG))))
    for cut in range(0, len(LOG) + 1, 2):
        assert rows(A.decisions(m, A.fold(events(spark, LOG[cut:]), A.fold(events(spark, LOG[:cut]))))) == whole
    assert rows(A.decisions(m, A.fold(events(spark, LOG[::-1]).repartition(3)))) == whole


def test_decisions(spark):
    d = {r.source_uid: r for r in A.decisions(manifest(spark, SIZES), A.fold(events(spark, LOG))).collect()}
    assert (d["pair"].state, d["pair"].final_label, d["pair"].final_period_d) == ("blind_repeat_agreement", "planet_like", 2.0)
    assert (d["one"].final_factor, d["one"].final_status, d["one"].final_period_d) == ("0.5", "refolded", 1.0)  # records without a time are older
    assert (d["factor"].state, d["factor"].is_final, d["factor"].final_label) == ("discordant", False, "")
    assert (d["silent"].state, d["silent"].n_events) == ("unreviewed", 0)


def test_third_pass_queue_shows_only_public_columns(spark):
    m = manifest(spark, SIZES)
    public, hidden = A.resolution_queue(m, A.decisions(m, A.fold(events(spark, LOG))), ["review_period_d"])
    assert public.columns == ["row_id", "review_id", "review_period_d"]
    assert rows(hidden) == [(0, "resolution:000", "factor", "gfactor")]


def test_review_load_refuses_what_disagrees(spark):
    q = spark.createDataFrame([(0, "a"), (1, "b")], "row_id bigint, candidate_key string")
    m = q.withColumns({"source_uid": F.lit("s"), "review_period_d": F.lit(2.0)})
    log = spark.createDataFrame([(0, 0, None, "planet_like", "?"), (0, 1, None, "planet_like", "2.0")], "row_id bigint, seq bigint, updated_utc timestamp, label string, period_factor string")
    assert [(r.label, r.period_factor, r.period_d) for r in A.review_load(q, log, m).orderBy("row_id").collect()] == [("planet_like", "2", 4.0), ("", "", None)]
    for bad in ((q, log, m.where("row_id = 0")), (q, log, m.withColumn("candidate_key", F.lit("z"))), (q, log, m.union(m)), (q, log.withColumn("row_id", F.lit(7)), m),
                (q, log.withColumn("period_factor", F.lit("3")), m), (q, log, m.withColumn("source_uid", F.lit(None).cast("string")))):
        with pytest.raises(ValueError):
            A.review_load(*bad)


def test_queue_refuses_lost_signals_and_leaves_signal_targets_out_of_controls(spark):
    cols = "review_id bigint, tic bigint, origin string, label string, period_d double, tmag double, sde_max double"
    data = [(i, i // 2, "o", "planet_like" if i == 0 else "skip", float(i % 7), float("nan") if i % 5 == 0 else 1.0 * i, None if i == 3 else 1.0) for i in range(40)]
    now = spark.createDataFrame(data, cols)
    q = A.adjudication_queue(now, now, {}, ["skip"], 12, 1).collect()
    assert len(q) == 13 and all(r.tic != 0 for r in q if r.cohort == "control")
    with pytest.raises(ValueError, match="missing"):
        A.adjudication_queue(now, now.where("review_id > 0"), {}, ["skip"], 12, 1)


def test_quartiles_agree_between_one_window_and_ranges(spark):
    d = spark.range(500).select(F.col("id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("p"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    few, many = (rows(A.pool_quartile(d, ["p"], "v", "id", "q", limit).select("id", "q")) for limit in (10_000, 20))
    assert few == many
    pdf = d.toPandas().sort_values(["p", "v", "id"])
    pdf["q"] = (pdf.groupby("p").cumcount() * 4 // pdf.groupby("p").id.transform("size") + 1).map("q{}".format)
    assert few == sorted(zip(pdf.id, pdf.q), key=repr)


@pytest.mark.parametrize("limit,block", [(10_000, 4096), (50, 24)])
def test_adaptive_median_equals_the_row_rule(spark, limit, block):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.uniform(15, 21, 700), 1), rng.normal(size=700)
    d = spark.createDataFrame(pd.DataFrame({"k": np.arange(700), "x": x, "y": y}))
    bad = spark.createDataFrame([(900, None, 1.0), (901, 16.0, float("nan")), (902, float("inf"), 1.0)], "k bigint, x double, y double")
    got = O.with_adaptive_median(d.union(bad), "x", "y", "k", (16.0, 23), (20.0, 2), limit=limit, block=block).toPandas().set_index("k").smooth
    order = np.lexsort((np.arange(700), x))
    half = np.maximum(1, np.maximum(1, np.rint(np.interp(x[order], [16, 20], [23, 2]))).astype(int) // 2)
    want = {k: np.median(y[order][max(0, i - h):i + h + 1]) for i, (k, h) in enumerate(zip(order, half))}
    assert len(got) == 700 and all(abs(got[k] - w) < 1e-12 for k, w in want.items())


@pytest.mark.parametrize("hot", [False, True])
def test_ragged_chunks_keep_every_value_in_place(spark, hot):
    data = [(k, float(i), i, float(i + k)) for k, n in ((1, 103), (2, 5), (3, 8)) for i in range(n)] + [(4, 0.0, 0, None), (4, 1.0, 1, float("nan"))]
    d = spark.createDataFrame(data, "k bigint, time double, c bigint, v double")
    c = V.ragged_chunks(d, ["k"], ["time", "c"], ["v"], 8, hot, 10.0)
    assert all(len(r.v) == len(r["mask"]) == len(r.mask_v) == 8 for r in c.collect())
    back = {k: list(itertools.chain.from_iterable(r.v[:r.n_real] for r in sorted(c.where(F.col("k") == k).collect(), key=lambda r: r.chunk))) for k in (1, 2, 3, 4)}
    assert back == {1: [i + 1.0 for i in range(103)], 2: [i + 2.0 for i in range(5)], 3: [i + 3.0 for i in range(8)], 4: [0.0, 0.0]}
    lengths = {r.k: (r.n_real, r.n_chunks, r.longest) for r in V.ragged_lengths(c, ["k"]).collect()}
    assert lengths == {1: (103, 13, 103), 2: (5, 1, 103), 3: (8, 1, 103), 4: (2, 1, 103)}
    assert c.where("k = 4").first().mask_v == [0.0] * 8
    ok = V.ragged_contract(c, ["k"], ["v"], 8).first()
    assert ok.passed and ok.n_chunks == 16 and ok.n_keys == 4


def test_ragged_contract_finds_each_fault(spark):
    d = spark.range(40).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("time"), F.col("id").alias("c"), F.col("id").cast("double").alias("v"))
    c = V.ragged_chunks(d, ["k"], ["time", "c"], ["v"], 8)
    check = lambda x: V.ragged_contract(x, ["k"], ["v"], 8).first()
    assert check(c.where("chunk <> 2")).n_with_gaps == 1
    assert check(c.withColumn("v", F.slice("v", 1, 7))).n_wrong_length == 5
    early = c.withColumn("n_real", F.when(F.col("chunk") == 1, 3).otherwise(F.col("n_real")))
    assert (check(early).n_padded_early, check(early).n_wrong_mask, check(early).passed) == (1, 1, False)
    assert not check(c.where("false")).passed


def test_thinned_fold_takes_even_ranks(spark):
    t = np.arange(0, 50, 0.25)
    d = spark.createDataFrame([(1, a, float(x), i, 1.0 + 0.01 * i * (a == "PRI")) for i, x in enumerate(t) for a in ("SML", "PRI")], "review_id bigint, aperture string, time double, cadenceno bigint, flux double") \
        .withColumns({"period_d": F.lit(7.3), "t0_bjd": F.lit(0.1), "duration_min": F.lit(2000.0)})
    for hot in (False, True):
        f = V.thinned_fold(d, 9, 4.0, hot=hot).where("view = 'model'").orderBy("slot").collect()
        x = np.sort(((t - 0.1 + 3.65) % 7.3 - 3.65) * 1440 / 2000)
        x = x[np.abs(x) <= 4]
        take = np.linspace(0, x.size - 1, 9).round().astype(int)
        assert [r.slot for r in f] == list(range(9)) and f[0].n_all == x.size
        assert np.allclose([r.x * 4 for r in f], x[take], atol=1e-9)
