"""Evaluation: confusion, calibration, ranking curves, thresholds and recalls.

Curves are computed on distinct scores: rows are first reduced to (score, positives, total), and running sums over
that list come from range buckets with offsets when it is long, so no task sorts all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.operators.ordering import cut_lineage
from lumensift.session import hot_rows
from lumensift.operators.skew import with_row


def score_predictions(df: DataFrame, probs: dict[str, str]) -> DataFrame:
    """argmax class, confidence, margin and normalised entropy of class probabilities."""
    arr = F.array(*[F.struct(F.col(c).alias("p"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(probs.items())])
    s = F.array_sort(arr)
    ps = F.array(*[F.col(c) for c in probs.values()])
    ent = -F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(F.greatest(p, F.lit(1e-300)))).otherwise(0.0))
    k = len(probs)
    return df.withColumn("_s", s).withColumns({
        "predicted": F.element_at("_s", k)["n"], "confidence": F.element_at("_s", k)["p"],
        "margin": F.element_at("_s", k)["p"] - F.element_at("_s", k - 1)["p"], "entropy": ent / F.log(F.lit(float(k))), "entropy_nats": ent}).drop("_s")


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(conf: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall and F1 per class from the confusion table (a handful of rows)."""
    rows = conf.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), (F.col(truth) == F.col(pred)).alias("hit"), F.lit(0).alias("side"), "n"),
                                        F.struct(F.col(pred).alias("label"), (F.col(truth) == F.col(pred)).alias("hit"), F.lit(1).alias("side"), "n"))).alias("x")).select("x.*")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = rows.groupBy("label").agg(s((F.col("side") == 0) & F.col("hit")).alias("tp"), s(F.col("side") == 0).alias("support"), s(F.col("side") == 1).alias("n_predicted"))
    p, r = F.col("tp") / F.nullif("n_predicted", F.lit(0)), F.col("tp") / F.nullif("support", F.lit(0))
    p0, r0 = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return g.withColumns({"precision": p0, "recall": r0, "f1": F.when(p0 + r0 > 0, 2 * p0 * r0 / F.nullif(p0 + r0, F.lit(0.0))).otherwise(0.0)})


def summary_metrics(per_class: DataFrame) -> DataFrame:
    has = F.col("support") > 0
    return per_class.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(has, F.col("recall"))).alias("balanced_accuracy"), F.avg(F.when(has, F.col("f1"))).alias("macro_f1"))


def calibration_bins(df: DataFrame, confidence: str, correct: Column, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    b = F.least(F.floor(F.col(confidence) * n_bins), F.lit(n_bins - 1).cast("bigint")).alias("bin")
    return df.groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def expected_calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("ece"))


def score_levels(df: DataFrame, score: str, positive: Column, n_buckets: int = 512) -> DataFrame:
    """Distinct scores, best first, with running totals: n, pos (this level), cum_n, cum_pos (levels at or above).

    Long lists are cut at approximate score quantiles; totals of better buckets are added as offsets, so any cuts
    give exact sums.
    """
    lev = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("pos"))
    limit = hot_rows(df.sparkSession)
    run = lambda part: W.partitionBy(*part).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    lev = cut_lineage(lev)
    if lev.limit(limit + 1).count() <= limit:
        return lev.withColumns({"cum_n": F.sum("n").over(run([])), "cum_pos": F.sum("pos").over(run([]))})
    cuts = sorted(set(lev.approxQuantile("score", [i / n_buckets for i in range(1, n_buckets)], 0.001)), reverse=True)
    b = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("score")))
    d = lev.withColumn("_b", b)
    t = d.groupBy("_b").agg(F.sum("n").alias("tn"), F.sum("pos").alias("tp"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    t = t.select("_b", F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("on"), F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("op"))
    d = d.join(F.broadcast(t), "_b")
    return d.withColumns({"cum_n": F.col("on") + F.sum("n").over(run(["_b"])), "cum_pos": F.col("op") + F.sum("pos").over(run(["_b"]))}).drop("_b", "on", "op")


def ranking_metrics(levels: DataFrame, cut: float = 0.5) -> DataFrame:
    """Average precision (ties share their level's precision), rank AUC with ties, precision and recall at ``cut``."""
    tot = levels.agg(F.sum("n").alias("n"), F.sum("pos").alias("n_positive"),
                     F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("_ap"),
                     # pairs (positive, negative): negatives strictly below count 1, tied ones one half
                     F.sum(F.col("pos") * (F.col("cum_n") - F.col("cum_pos") - (F.col("n") - F.col("pos")) / 2)).alias("_above"),
                     F.sum(F.when(F.col("score") >= cut, F.col("pos"))).alias("_tp"), F.sum(F.when(F.col("score") >= cut, F.col("n"))).alias("_np"))
    neg = F.col("n") - F.col("n_positive")
    return tot.select("n", "n_positive", (F.col("_ap") / F.nullif("n_positive", F.lit(0))).alias("average_precision"),
                      (1 - F.col("_above") / F.nullif(F.col("n_positive") * neg, F.lit(0))).alias("roc_auc"),
                      (F.coalesce("_tp", F.lit(0)) / F.nullif("_np", F.lit(0))).alias("precision_at_cut"), (F.coalesce("_tp", F.lit(0)) / F.nullif("n_positive", F.lit(0))).alias("recall_at_cut"))


def budget_curve(levels: DataFrame) -> DataFrame:
    """Share reviewed against share of positives found, level by level."""
    tot = levels.agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    d = levels.transform(with_row, tot)
    return d.select("score", (F.col("cum_n") / F.col("_n")).alias("reviewed_fraction"), (F.col("cum_pos") / F.nullif("_p", F.lit(0))).alias("recall"), (F.col("cum_pos") / F.col("cum_n")).alias("precision"))


def value_at_budget(curve: DataFrame, budget: float) -> DataFrame:
    return curve.where(F.col("reviewed_fraction") <= budget).agg(F.max("recall").alias("recall_at_budget"), F.max_by("score", "reviewed_fraction").alias("threshold"))


def workload_threshold(df: DataFrame, score: str, max_fraction: float, target: str = "tic") -> DataFrame:
    """Lowest threshold whose passing targets stay within the budget; a tie over the budget moves it up.

    Only the first ``allowed`` targets are ever ordered, by a bounded top-k.
    """
    per = df.groupBy(target).agg(F.max(score).alias("score"))
    lev = score_levels(per, "score", F.lit(False))
    n = per.count()
    allowed = int(max_fraction * n)
    ok = lev.where(F.col("cum_n") <= allowed)
    return ok.agg(F.lit(n).alias("n_targets"), F.lit(allowed).alias("max_pass"), F.coalesce(F.max("cum_n"), F.lit(0)).alias("n_pass"), F.min("score").alias("threshold"))


def recall_at_thresholds(df: DataFrame, score: str, thresholds: DataFrame, by: str = "fold") -> DataFrame:
    """Share of injections with a true, passing candidate at their fold's threshold."""
    d = df.join(F.broadcast(thresholds.select(by, F.col("threshold").alias("_t"))), by)  # one row per fold
    per = d.groupBy(by, "injection_id").agg(F.bool_or(F.col("is_signal") & (F.col(score) >= F.col("_t"))).alias("hit"))
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("n_injections"), F.count_if("hit").alias("n_recovered"), F.avg(F.col("hit").cast("double")).alias("recovery_fraction"))


def selection_score(recall: Column, macro_f1: Column, ap: Column, ece: Column) -> Column:
    """.60 recall + .25 macro-F1 + .10 average precision + .05 (1 - ECE); minus infinity when anything is missing."""
    total = 0.60 * recall + 0.25 * macro_f1 + 0.10 * ap + 0.05 * (1 - ece)
    return F.when(total.isNull() | F.isnan(total), F.lit(float("-inf"))).otherwise(total)


def ensemble(members: DataFrame, probs: Sequence[str], key: str = "review_id") -> DataFrame:
    """Mean and population spread per class, disagreement, entropy in nats, margin and argmax."""
    g = members.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"), *[F.avg(p).alias(p) for p in probs], *[F.stddev_pop(p).alias(f"std_{p}") for p in probs])
    d = g.withColumn("disagreement", sum((F.col(f"std_{p}") for p in probs[1:]), F.col(f"std_{probs[0]}")) / len(probs))
    return score_predictions(d, {p: p for p in probs})


def ensemble_scores(members: DataFrame, score: str, key: str = "review_id") -> DataFrame:
    """Mean, sample spread (0 for one member), maximum and count."""
    return members.groupBy(key).agg(F.avg(score).alias("p_mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("p_std"), F.max(score).alias("p_max"), F.count(score).alias("n_members"))


def join_score_tables(a: DataFrame, b: DataFrame, key: str, identity: Sequence[str], score_cols: Sequence[str], tol: float = 1e-10) -> DataFrame:
    """Two score tables over the same ids with a state per row: both, one side only, or identity conflict."""
    l = a.withColumn("_l", F.lit(True))
    r = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in identity], *[F.col(c).alias(f"other_{c}") for c in score_cols]).withColumn("_r", F.lit(True))
    j = l.join(r, key, "full_outer")
    same = F.lit(True)
    for c in identity:
        same = same & (F.abs(F.col(c) - F.col(f"_b_{c}")) <= tol)
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(~same, "identity_conflict").otherwise("both")
    return j.withColumn("state", state).drop("_l", "_r", *[f"_b_{c}" for c in identity])


def class_weights(df: DataFrame, klass: str, cap: float) -> DataFrame:
    """min(cap, sqrt(largest class / class)) scaled to mean 1 over active rows; class sizes are a tiny table."""
    n = df.where(F.col(klass).isNotNull()).groupBy(klass).agg(F.count(F.lit(1)).alias("_n"))
    top = n.agg(F.max("_n").alias("_top"))
    w = n.transform(with_row, top).withColumn("_w", F.least(F.lit(cap), F.sqrt(F.col("_top") / F.col("_n"))))
    mean = w.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    w = w.transform(with_row, mean).select(klass, (F.col("_w") / F.col("_mean")).alias("weight"))
    # a row per class: rows are never dealt by class, whose few values would be few tasks
    return df.join(F.broadcast(w), klass, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def equalise(df: DataFrame, weight: str, group: Column) -> DataFrame:
    """Scale the named groups (non-NULL) to their mean total weight; other rows keep theirs."""
    d = df.withColumn("_g", group)
    t = d.where("_g IS NOT NULL").groupBy("_g").agg(F.sum(weight).alias("_t")).where("_t > 0")
    goal = t.agg(F.avg("_t").alias("_goal"), F.count(F.lit(1)).alias("_k"))
    f = t.transform(with_row, goal).select("_g", F.when(F.col("_k") >= 2, F.col("_goal") / F.col("_t")).otherwise(1.0).alias("_f"))
    return d.join(f, "_g", "left").withColumn(weight, F.col(weight) * F.coalesce("_f", F.lit(1.0))).drop("_g", "_f")


def sample_weights(df: DataFrame, klass: str = "target", source: str = "is_injected", cap: float = 4.0, injected_share: float = 0.25, equal_class: str = "planet_like") -> DataFrame:
    """Capped class weights; injected rows of a class hold at most a share of its real total (all of it for one class); mean 1."""
    d = class_weights(df, klass, cap)
    t = d.groupBy(klass).agg(F.sum(F.when(~F.col(source), F.col("weight"))).alias("_real"), F.sum(F.when(F.col(source), F.col("weight"))).alias("_inj"))
    limit = F.when(F.col(klass) == equal_class, F.col("_real")).otherwise(injected_share * F.col("_real"))
    f = t.select(klass, F.when((F.col("_real") > 0) & (F.col("_inj") > limit), limit / F.nullif("_inj", F.lit(0.0))).otherwise(1.0).alias("_f"))
    d = d.join(f, klass, "left").withColumn("weight", F.when(F.col(source), F.col("weight") * F.coalesce("_f", F.lit(1.0))).otherwise(F.col("weight"))).drop("_f")
    mean = d.where("weight > 0").agg(F.avg("weight").alias("_m"))
    return d.transform(with_row, mean).withColumn("weight", F.col("weight") / F.col("_m")).drop("_m")


def pseudo_labels(df: DataFrame, min_confidence: float = 0.98, min_margin: float = 0.5, per_class: int = 5000, key: str = "review_id") -> DataFrame:
    w = W.partitionBy("predicted").orderBy(F.desc("confidence"), key)
    ok = df.where((F.col("confidence") >= min_confidence) & (F.col("margin") >= min_margin))
    return ok.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_class).drop("_r")


def review_priority(df: DataFrame, n: int, key: str = "review_id") -> DataFrame:
    """.65 entropy + .25 scaled strength + .10 confidence, first n."""
    lim = df.agg(F.min(F.coalesce("sde_max", F.lit(0.0))).alias("_lo"), F.max(F.coalesce("sde_max", F.lit(0.0))).alias("_hi"))
    d = df.transform(with_row, lim)
    s = F.when(F.col("_hi") > F.col("_lo"), (F.coalesce("sde_max", F.lit(0.0)) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).otherwise(0.0)
    pr = 0.65 * F.coalesce("entropy", F.lit(0.0)) + 0.25 * s + 0.10 * F.coalesce("confidence", F.lit(0.0))
    return d.withColumn("review_priority", pr).drop("_lo", "_hi").orderBy(F.desc("review_priority"), key).limit(n)
