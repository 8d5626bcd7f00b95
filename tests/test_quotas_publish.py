import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumensift.operators import quotas as Q
from lumensift.sources import sinks


def plain(pdf, rules, n, hashes, order):
    """Bucket after bucket over the whole table."""
    used, out = set(), {}
    for i, (name, quota, mask, ranked) in enumerate(rules):
        d = pdf[mask(pdf) & ~pdf.k.isin(used)].copy()
        d["h"] = hashes[i].reindex(d.k).to_numpy()
        d = d.sort_values([*(order if ranked else []), "h", "k"]).head(min(n if quota is None else quota, n - len(used)))
        used |= set(d.k)
        out.update({k: name for k in d.k})
    return out


@pytest.mark.parametrize("n", [0, 7, 60, 200])
def test_quotas_equal_filling_one_after_another(spark, n):
    d = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 37 % 50).cast("double").alias("s"), (F.col("id") % 3).alias("c"))
    rules = [("a", 25, lambda p: p.c == 0, True), ("b", 30, lambda p: p.s > 10, False), ("none", 5, lambda p: p.c > 9, True), ("c", 20, lambda p: p.s <= 30, True), ("fill", None, lambda p: p.c < 2, False), ("over", None, lambda p: p.c >= 0, True)]
    quotas = [Q.Quota("a", 25, F.col("c") == 0, True), Q.Quota("b", 30, F.col("s") > 10), Q.Quota("none", 5, F.col("c") > 9, True), Q.Quota("c", 20, F.col("s") <= 30, True), Q.Quota("fill", None, F.col("c") < 2), Q.Quota("over", None, F.lit(True), True)]
    hashes = [d.select("k", Q.digest(F.col("k"), 3 + i).alias("h")).toPandas().set_index("k").h for i in range(len(rules))]
    got = Q.select_quotas(d, quotas, n, 3, "k", [-F.col("s")]).toPandas()
    pdf = d.toPandas().assign(minus=lambda p: -p.s)
    want = plain(pdf, rules, n, hashes, ["minus"])
    assert dict(zip(got.k, got.selection_bucket)) == want
    for b, part in got.groupby("selection_bucket"):
        mask = next(r[2] for r in rules if r[0] == b)(pdf)
        assert (part.selection_weight - mask.sum() / len(part)).abs().max() < 1e-12


def test_missing_orders_and_conditions_come_last_or_fall_out(spark):
    d = spark.createDataFrame([(1, None, True), (2, 5.0, None), (3, 1.0, True), (4, 2.0, True)], "k bigint, s double, w boolean")
    got = Q.select_quotas(d, [Q.Quota("a", 2, F.col("w"), True), Q.Quota("rest", None, F.lit(True))], 4, 1, "k", [F.col("s")])
    assert {r.k: r.selection_bucket for r in got.collect()} == {3: "a", 4: "a", 1: "rest", 2: "rest"}
    with pytest.raises(ValueError, match="wanted"):
        Q.select_quotas(d, [Q.Quota("a", None, F.col("w"))], 4, 1, "k")


def test_balanced_buckets_share_over_cells(spark):
    rows = [(i, "m", 0) for i in range(50)] + [(50 + i, "m", 1) for i in range(3)] + [(60 + i, "o", i) for i in range(4)] + [(90, "x", 0)]
    d = spark.createDataFrame(rows, "k bigint, mode string, cell int")
    g = {(r.mode, r.cell): r["count"] for r in Q.balanced_buckets(d, "mode", {"m": 10, "o": 9}, ["cell"], 2, "k").groupBy("mode", "cell").count().collect()}
    assert g == {("m", 0): 7, ("m", 1): 3, **{("o", i): 1 for i in range(4)}}


def test_edges_and_scaled_quotas(spark):
    d = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.15, 0.2, 0.25, 0.3)], "v double")
    assert [r[0] for r in d.select(Q.edge_bin("v", [0.1, 0.15, 0.25])).collect()] == [None, 0, 0, 1, 1, None]
    q = Q.scaled_quotas(Q.REVIEW_QUOTAS, 100, "real_benchmark", "real_high_sde_planet_like")
    assert sum(q.values()) == 100 and q["real_benchmark"] == 1 and min(q.values()) >= 1
    assert Q.scaled_quotas(Q.REVIEW_QUOTAS, 700, "real_benchmark", "real_high_sde_planet_like") == Q.REVIEW_QUOTAS


@pytest.fixture
def source(spark, tmp_path):
    spark.range(50).select("id", (F.col("id") * 2).alias("v")).repartition(3).write.parquet(f"{tmp_path}/in")
    return str(tmp_path)


def test_publish_and_read_back(spark, source):
    m = sinks.publish(spark, lambda i: i["a"].where("id < 20"), {"a": f"{source}/in"}, f"{source}/out", "v1", ["id", "v"])
    assert m["n_distinct_rows"] == 20 and m["inputs"]["a"]["n_rows"] == 50 and m["inputs"]["a"]["n_files"] == 3
    assert sinks.read_published(spark, f"{source}/out", "v1").count() == 20
    assert os.listdir(f"{source}/out") == ["v1"]
    with pytest.raises(FileExistsError):
        sinks.publish(spark, lambda i: i["a"], {"a": f"{source}/in"}, f"{source}/out", "v1", ["id"])
    with pytest.raises(ValueError, match="collides"):
        sinks.publish(spark, lambda i: i["a"], {"a": f"{source}/in"}, f"{source}/in/out", "v1", ["id"])
    spark.range(1).select("id", F.lit(1).cast("bigint").alias("v")).write.mode("append").parquet(f"{source}/out/v1/data")
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_published(spark, f"{source}/out", "v1")


@pytest.mark.parametrize("change", ["append", "same_rows"])
def test_publish_refuses_an_input_that_changes_during_the_run(spark, source, change):
    def build(i):
        out = i["a"].toPandas()
        if change == "append":
            spark.range(1).select("id", F.lit(1).cast("bigint").alias("v")).write.mode("append").parquet(f"{source}/in")
        else:  # the same rows, other files
            spark.createDataFrame(out).write.mode("overwrite").parquet(f"{source}/in")
        return spark.createDataFrame(out)

    with pytest.raises(sinks.InputChanged, match="a"):
        sinks.publish(spark, build, {"a": f"{source}/in"}, f"{source}/out", "v1", ["id", "v"])
    assert os.listdir(f"{source}/out") == []


def test_publish_leaves_nothing_of_a_failed_build(spark, source):
    with pytest.raises(ZeroDivisionError):
        sinks.publish(spark, lambda i: 1 / 0, {"a": f"{source}/in"}, f"{source}/out", "v1", ["id"])
    assert not os.path.exists(f"{source}/out/v1")


def test_fingerprint_sees_doubled_and_altered_rows(spark, tmp_path):
    def of(name, rows):
        spark.createDataFrame(pd.DataFrame(rows, columns=["id", "v"])).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        f = sinks.input_fingerprint(spark.read.parquet(f"{tmp_path}/{name}")).first()
        return f.n_rows, f.sum_a, f.sum_b
    base = of("a", [(1, 2.0), (2, 3.0)])
    assert base == of("b", [(2, 3.0), (1, 2.0)])
    assert len({base, of("c", [(1, 2.0), (2, 3.0), (2, 3.0)]), of("d", [(1, 3.0), (2, 2.0)]), of("e", [(1, None), (2, 3.0)])}) == 4
