"""Label logs, review queues, adjudication and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import skew
from lumensift.operators.ordering import with_global_row_number
from lumensift.operators.vet import first_by
from lumensift.operators.skew import with_row


def latest_labels(log: DataFrame) -> DataFrame:
    """Newest record per row id; missing times count as oldest, later log positions win ties."""
    rest = [c for c in log.columns if c != "row_id"]
    newest = F.struct(F.col("updated_utc").isNotNull().alias("a"), F.col("updated_utc").alias("b"), F.col("seq").alias("c"))
    g = log.where("row_id IS NOT NULL").groupBy("row_id").agg(F.max_by(F.struct(*rest), newest).alias("_r"))
    return g.select("row_id", "_r.*")


def normalise_queue(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Display row ids from an explicit order, and the canonical key."""
    return with_global_row_number(df, order, "_p").withColumn("row_id", F.col("_p") - 1).drop("_p").withColumn("candidate_key", E.candidate_key())


def join_latest(queue: DataFrame, labels: DataFrame) -> DataFrame:
    """Queue with its labels on row id; keys must agree where both exist."""
    l = labels.select("row_id", *[F.col(c).alias(f"label_{c}") for c in labels.columns if c != "row_id"])
    out = queue.join(l, "row_id", "left")
    if "label_candidate_key" in out.columns:
        agree = F.col("label_candidate_key").isNull() | (F.col("label_candidate_key") == F.col("candidate_key"))
        skew.require(out, agree, "label rows disagree with the queue key")
    return out


def label_integrity(queue: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of duplicate, unknown and key-mismatched label rows; all must be zero."""
    dup = labels.groupBy("row_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_duplicate"))
    unknown = labels.join(queue, "row_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    mism = labels.join(queue.select("row_id", F.col("candidate_key").alias("_k")), "row_id").where(~F.col("candidate_key").eqNullSafe(F.col("_k"))) \
        .agg(F.count(F.lit(1)).alias("n_mismatch"))
    return dup.transform(with_row, unknown).transform(with_row, mism)


def join_by_key(labels: DataFrame, queue: DataFrame) -> DataFrame:
    """Labels to queue by the rebuilt key only; target and sector must agree."""
    l = labels.withColumn("_key", E.candidate_key())
    q = queue.select(E.candidate_key().alias("_key"), F.col("review_id").alias("queue_review_id"), F.col("tic").alias("_qt"), F.col("sector").alias("_qs"))
    out = l.join(q, "_key", "left")
    state = (F.when(F.col("queue_review_id").isNull(), "unmatched").when((F.col("tic") != F.col("_qt")) | (F.col("sector") != F.col("_qs")), "identity_conflict").otherwise("matched"))
    return out.withColumn("join_state", state).drop("_qt", "_qs").withColumnRenamed("_key", "candidate_key")


def label_roles(df: DataFrame, rare_below: int) -> DataFrame:
    """Training target with rare classes set aside, and audit and exclusion flags."""
    target = E.label_target("label")
    d = df.withColumn("target", target)
    sizes = d.groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(sizes, "target")
    rare = (F.col("_n") < rare_below) & (F.col("target") != "")
    return d.withColumns({"is_audit": F.col("label") == "uncertain", "is_excluded": F.col("target") == "", "is_rare": rare,
                          "main_include": (F.col("target") != "") & ~rare & (F.col("label") != "uncertain")}).drop("_n")


def refold_annotations(df: DataFrame, notes: str = "notes") -> DataFrame:
    """Reviewer notes as refold factor and the ephemeris a model should use."""
    d = df.withColumn("_n", E.note_refold(notes))
    f = F.coalesce(F.col("_n.factor"), F.lit(1.0))
    return d.withColumns({"harmonic_suspect": F.col("_n.suspect"), "refold_factor": F.col("_n.factor"), "refold_reason": F.col("_n.reason"),
                          "model_period_d": F.col("period_d") * f}).drop("_n")


def period_targets(df: DataFrame) -> DataFrame:
    """Effective period factor by precedence: default, earlier refold, button, unresolved, injection truth, note."""
    label, injected = F.col("label"), F.col("is_injected")
    transit = label.isin("planet_like", "eclipsing_binary_or_pceb", "wide_transit_like")
    truth = E.nearest_supported_factor(F.col("truth_period_d") / F.nullif("period_d", F.lit(0.0)))
    note = E.note_period_factor("notes")
    button_ok = F.col("adjudicated") & (F.col("button_factor") > 0)
    unresolved = F.col("adjudicated") & (F.col("period_status") == "unresolved")
    t_ok = F.coalesce(injected & transit, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    source = (F.when(note > 0, "note").when(t_ok & truth.isNotNull(), "injection_truth_harmonic").when(t_ok, "injection_truth_unresolved")
              .when(yes(unresolved), "unresolved").when(yes(button_ok), "adjudication_button").when(yes(F.col("legacy_factor") > 0), "legacy_refold").otherwise("default_p"))
    d = df.withColumns({"_note": note, "_truth": truth, "period_factor_source": source})
    s = F.col("period_factor_source")
    factor = (F.when(s == "note", F.col("_note")).when(s == "injection_truth_harmonic", F.col("_truth")).when(s == "adjudication_button", F.col("button_factor"))
              .when(s == "legacy_refold", F.col("legacy_factor")).when(s == "default_p", 1.0))
    d = d.withColumn("effective_factor", factor)
    name = F.when(transit, F.coalesce(E.harmonic_name("effective_factor"), F.lit(""))).otherwise("")
    known = s.isin("legacy_refold", "adjudication_button", "note", "injection_truth_harmonic")
    return d.withColumns({"effective_period_d": F.col("period_d") * F.col("effective_factor"), "harmonic_target": name}).withColumn(
        "harmonic_include", transit & (F.col("harmonic_target") != "") & known).drop("_note", "_truth")


def repeat_pairs(rows: DataFrame) -> DataFrame:
    """One row per repeat group: both labels and factors and how they agree (a conditional aggregate, no self-join)."""
    side = lambda occ, c: F.max(F.when(F.col("occurrence") == occ, F.col(c)))
    g = rows.groupBy("repeat_group").agg(
        F.count(F.lit(1)).alias("n_rows"), side("original", "label").alias("original_label"), side("blind_repeat", "label").alias("repeat_label"),
        side("original", "factor").alias("original_factor"), side("blind_repeat", "factor").alias("repeat_factor"))
    done = (F.coalesce("original_label", F.lit("")) != "") & (F.coalesce("repeat_label", F.lit("")) != "")
    same = F.col("original_label") == F.col("repeat_label")
    fac = F.col("original_factor").eqNullSafe(F.col("repeat_factor"))
    g = g.withColumns({"complete": done, "label_agreement": F.coalesce(done & same, F.lit(False)), "factor_agreement": done & fac})
    return g.withColumns({"exact_agreement": F.col("label_agreement") & F.col("factor_agreement"), "discordant": F.col("complete") & ~(F.col("label_agreement") & F.col("factor_agreement"))})


def agreement(pairs: DataFrame, left: str = "original_label", right: str = "repeat_label") -> DataFrame:
    """Observed and chance agreement and Cohen's kappa from the two marginals."""
    d = pairs.where("complete")
    both = d.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(left).alias("label")), F.struct(F.lit(1).alias("side"), F.col(right).alias("label")))).alias("x")).select("x.*")
    m = both.groupBy("label").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"))
    chance = m.agg(F.sum(F.col("l") * F.col("r")).alias("_c"))
    o = d.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col(left) == F.col(right)).cast("double")).alias("observed"))
    j = o.transform(with_row, chance).withColumn("expected", F.col("_c") / (F.col("n_pairs") * F.col("n_pairs")))
    kappa = F.when(F.abs(1 - F.col("expected")) < 1e-12, F.when(F.abs(1 - F.col("observed")) < 1e-12, 1.0)).otherwise((F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0)))
    return j.select("n_pairs", "observed", "expected", kappa.alias("kappa"))


def final_decisions(rows: DataFrame, resolution: DataFrame) -> DataFrame:
    """One decision per source: a single review, an agreeing repeat, or the third-pass resolution."""
    has = F.coalesce("label", F.lit("")) != ""
    g = rows.groupBy("source_uid").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(has).alias("n_labelled"), F.countDistinct(F.when(has, F.col("label"))).alias("n_labels"),
        F.countDistinct(F.when(has, F.coalesce("factor", F.lit("")))).alias("n_factors"), F.min_by(F.struct("label", "factor"), F.when(has, F.col("row_id"))).alias("_d"))
    j = g.join(resolution.select("source_uid", F.col("label").alias("_rl"), F.col("factor").alias("_rf")), "source_uid", "left")
    agree = (F.col("n_labels") == 1) & (F.col("n_factors") == 1)
    src = (F.when((F.col("n_rows") == 1) & (F.col("n_labelled") == 1), "single_review")
           .when((F.col("n_rows") == 2) & (F.col("n_labelled") == 2) & agree, "blind_repeat_agreement")
           .when((F.col("n_rows") == 2) & (F.col("n_labelled") == 2) & F.col("_rl").isNotNull(), "third_pass_resolution").otherwise(""))
    j = j.withColumn("decision_source", src)
    pick = lambda own, third: F.when(F.col("decision_source") == "third_pass_resolution", F.col(third)).when(F.col("decision_source") != "", F.col(own)).otherwise("")
    return j.select("source_uid", pick("_d.label", "_rl").alias("final_label"), pick("_d.factor", "_rf").alias("final_factor"), "decision_source", (F.col("decision_source") != "").alias("is_final"))


def transition_matrix(df: DataFrame, old: str, new: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Old x new label counts overall and by each cohort column in one pass (GROUPING SETS), new labels as columns."""
    dims = [old, *by]
    sets = [[F.col(old)], *[[F.col(old), F.col(b)] for b in by]]
    g = df.groupingSets(sets, *[F.col(c) for c in dims]).agg(F.grouping_id(*dims).alias("_g"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(new) == l).alias(f"to_{l}") for l in labels])
    # grouping id bits: a cleared bit marks a present column
    cohort, level = F.lit("all"), F.lit("")
    for i, b in enumerate(by):
        here = F.col("_g").bitwiseAND(F.lit(1 << (len(by) - 1 - i))) == 0
        cohort, level = F.when(here, b).otherwise(cohort), F.when(here, F.col(b).cast("string")).otherwise(level)
    return g.select(cohort.alias("cohort"), level.alias("level"), F.col(old).alias("old_label"), "n", *[f"to_{l}" for l in labels])


def overlay(base: DataFrame, revisit: DataFrame, key: str = "review_id") -> DataFrame:
    """Revisit labels replace base labels per id (upsert on the left)."""
    r = revisit.select(key, F.col("label").alias("_new"))
    return base.join(r, key, "left").withColumns({"label": F.coalesce(E.blank_to_null("_new"), F.col("label")), "was_revisited": F.col("_new").isNotNull()}).drop("_new")


def dedupe_by_priority(df: DataFrame, key: Column) -> DataFrame:
    """Last per key by (priority, time): a struct maximum."""
    d = df.withColumn("_key", key)
    g = d.groupBy("_key").agg(F.max_by(F.struct(*df.columns), F.struct("priority", F.col("updated_utc").isNotNull(), "updated_utc", "seq")).alias("_r"))
    return g.select("_r.*")


def stack_sources(sources: Sequence[tuple[str, int, DataFrame]]) -> DataFrame:
    """Label tables stacked with their source name and priority; missing columns become NULL."""
    out = None
    for name, priority, df in sources:
        one = df.withColumns({"label_origin": F.lit(name), "priority": F.lit(priority)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def reanchor(rows: DataFrame, peaks: DataFrame) -> DataFrame:
    """Replace a row's ephemeris by its target's current rank-1 peak."""
    top = first_by(peaks.where("peak_rank = 1"), ["tic"], -F.col("sde"), F.col("period_d"), F.col("t0_bjd")).select(
        "tic", F.col("period_d").alias("_p"), F.col("t0_bjd").alias("_t"), F.col("duration_min").alias("_d"))
    j = rows.join(top, "tic", "left")
    has = F.col("_p").isNotNull()
    return j.withColumns({"original_period_d": F.col("period_d"), "period_d": F.coalesce("_p", "period_d"), "t0_bjd": F.coalesce("_t", "t0_bjd"),
                          "duration_min": F.coalesce("_d", "duration_min"), "is_reanchored": has}).withColumn("period_relation", E.period_relation("original_period_d", F.when(has, F.col("period_d")))).drop("_p", "_t", "_d")


def binary_targets(df: DataFrame, positive: Sequence[str], drop: Sequence[str] = ("skip",)) -> DataFrame:
    return df.where(~F.col("label").isin(*drop)).withColumn("target", F.col("label").isin(*positive).cast("int"))


def revisit_variants(df: DataFrame, half_ids: DataFrame) -> DataFrame:
    """Each row once, and once more at half period for the listed ids."""
    h = half_ids.select("review_id").distinct().withColumn("_h", F.lit(True))
    d = df.join(h, "review_id", "left")
    v = F.when(F.col("_h"), F.array(F.lit("as_found"), F.lit("half_period"))).otherwise(F.array(F.lit("as_found")))
    d = d.withColumn("variant", F.explode(v)).drop("_h")
    return d.withColumn("period_d", F.when(F.col("variant") == "half_period", F.col("period_d") / 2).otherwise(F.col("period_d")))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts with fixed columns, so no extra job discovers the pivot values."""
    return df.groupBy(row).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(col) == v).alias(v) for v in values])


def false_negatives(predictions: DataFrame, target: str, n: int) -> DataFrame:
    """Rows of the target class predicted as something else, the most confident mistakes first."""
    return predictions.where((F.col("label") == target) & (F.col("predicted") != target)).orderBy(F.desc_nulls_last("confidence"), "review_id").limit(n)
