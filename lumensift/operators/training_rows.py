"""Training rows from reviewed and injected candidates: availability, splits, variants, targets, weights, locked comparisons.

Checks fail closed: a function that returns a table raises when rows break its contract, and its ``..._problems`` twin lists them.
Every join is on a row or injection id, so no key is hot unless ids repeat, which is an error here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import metrics as M
from lumensift.operators.ordering import cut_lineage
from lumensift.operators.skew import assert_unique, with_row

#: labels that supervise nothing, and labels of a periodic signal
UNTRAINABLE = ("", "skip")
SIGNALS = ("planet_like", "eclipsing_binary_or_pceb", "wide_transit_like")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _trainable(label: str) -> Column:
    return ~_text(label).isin(*UNTRAINABLE)


def _refuse(problems: DataFrame, message: str) -> None:
    first = problems.limit(5).collect()
    if first:
        raise ValueError(f"{message}: {[r.asDict() for r in first]}")


def include_mask(columns: Sequence[str], explicit: str = "native_input_include", targets: Sequence[str] = ("morphology_include", "preserve_include", "harmonic_include")) -> Column:
    """The explicit flag where the table has one, else any of its target flags; text counts as a flag, missing ones are false."""
    if explicit in columns:
        return E.text_bool(explicit)
    mask = F.lit(False)
    for c in targets:
        if c in columns:
            mask = mask | E.text_bool(c)
    return mask


def mark_availability(df: DataFrame, available: DataFrame, key: str = "tic", include: str = "native_input_include") -> DataFrame:
    """Rows whose target has a source stay included; status says whether a row was out before, lacks a source or is available."""
    before = E.text_bool(include) if include in df.columns else F.lit(True)
    has = F.col("_has").isNotNull()
    d = df.withColumn("_before", before).join(available.select(key).distinct().withColumn("_has", F.lit(1)), key, "left")
    return d.withColumns({"source_available": has, include: F.col("_before") & has,
                          "input_status": F.when(~F.col("_before"), "excluded_upstream").when(~has, "missing_source").otherwise("available")}).drop("_before", "_has")


def _last_splits(prior: DataFrame, order: str, key: str) -> DataFrame:
    last = F.max(F.struct(F.col(order), F.col("fixed_split"), F.col("cv_fold"))).alias("_s")
    return prior.groupBy(F.col(key).alias("_key")).agg(last).select("_key", "_s.fixed_split", "_s.cv_fold")


def _with_prior(rows: DataFrame, prior: DataFrame, order: str, key: str) -> DataFrame:
    own = "source_review_id" if "source_review_id" in rows.columns else key
    d = rows.drop("fixed_split", "cv_fold")
    return d.join(_last_splits(prior, order, key), F.col(own) == F.col("_key"), "left").drop("_key")


def split_problems(rows: DataFrame, prior: DataFrame, order: str, key: str = "review_id", label: str = "human_label") -> DataFrame:
    """Trainable rows without an earlier split."""
    d = _with_prior(rows, prior, order, key)
    return d.where(_trainable(label) & (F.col("fixed_split").isNull() | F.col("cv_fold").isNull())).select(key, label)


def attach_prior_splits(rows: DataFrame, prior: DataFrame, order: str, key: str = "review_id", label: str = "human_label") -> DataFrame:
    """Every row takes the split its review (or the review it came from) had last, by ``order``; untrainable rows may have none."""
    assert_unique(rows, [key], "rows")
    _refuse(split_problems(rows, prior, order, key, label), "trainable rows without an earlier split")
    return _with_prior(rows, prior, order, key)


def scope_problems(roles: DataFrame, truth: DataFrame, identity: Sequence[str] = ("tic", "sector", "grid_cell_id"), key: str = "injection_id") -> DataFrame:
    """(key, problem): ids that repeat on a side, ids without truth, identity columns that disagree or are missing."""
    shared = [c for c in identity if c in roles.columns and c in truth.columns]
    side = lambda d, n: d.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias(f"_n{n}"), *[F.min(F.col(c).cast("string")).alias(f"_{n}_{c}") for c in shared])
    d = side(roles, "r").join(side(truth, "t"), key, "full")
    off = F.lit(None).cast("string")
    for c in reversed(shared):
        off = F.when(~F.coalesce(F.col(f"_r_{c}") == F.col(f"_t_{c}"), F.lit(False)), f"differs_{c}").otherwise(off)
    problem = (F.when(F.col("_nr") > 1, "repeated_role").when(F.col("_nt") > 1, "repeated_truth").when(F.col("_nr").isNull(), None)
               .when(F.col("_nt").isNull(), "no_truth").otherwise(off))
    return d.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def scoped_truth(roles: DataFrame, truth: DataFrame, identity: Sequence[str] = ("tic", "sector", "grid_cell_id"), key: str = "injection_id") -> DataFrame:
    """The truth rows of exactly the role ids, with the columns that only the roles have; truth wins where both have one."""
    _refuse(scope_problems(roles, truth, identity, key), "roles and truth disagree")
    extra = [c for c in roles.columns if c != key and c not in truth.columns]
    r = roles.select(F.col(key).cast("string").alias(key), *extra)
    return truth.withColumn(key, F.col(key).cast("string")).join(r, key)


def eligible_schedule(schedule: DataFrame, registry: DataFrame, eligible: str, key: str = "tic") -> DataFrame:
    """Scheduled rows whose target the registry calls eligible."""
    return schedule.join(registry.where(E.text_bool(eligible)).select(key).distinct(), key, "left_semi")


def eligibility_gate(schedule: DataFrame, registry: DataFrame, eligible: str, cell: str, minimum: int, key: str = "tic") -> DataFrame:
    """One row: whether enough rows remain and every scheduled cell (a missing cell is a cell) keeps some; one pass over the schedule."""
    ok = registry.where(E.text_bool(eligible)).select(key).distinct().withColumn("_ok", F.lit(1))
    c = schedule.select(key, cell).join(ok, key, "left").groupBy(cell).agg(F.count("_ok").alias("n"))
    g = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_selected"), F.count(F.lit(1)).alias("expected_cells"), F.count_if(F.col("n") > 0).alias("n_cells"),
              F.coalesce(F.min(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("cell_min"), F.coalesce(F.max("n"), F.lit(0)).alias("cell_max"))
    return g.withColumn("passed", (F.col("n_selected") >= minimum) & (F.col("n_cells") == F.col("expected_cells")))


def injection_rows(candidates: DataFrame, roles: DataFrame, split_columns: Sequence[str] = ("fixed_split", "cv_fold"), tol: float = K.PERIOD_TOL) -> DataFrame:
    """Rows of injections with a matched candidate: matches are positive, their other peaks hard negatives, and every match gives
    a paired row of the curve before injection as a shape-only negative.

    Needs review_id, injection_id, is_match and harmonic_factor; ``roles`` holds the split of every injection. A match whose
    factor no target supports, a candidate outside the schedule or a repeated review id is an error.
    """
    candidates = cut_lineage(candidates)  # checks and joins read them again
    assert_unique(candidates, ["review_id"], "candidates")
    assert_unique(roles, ["injection_id"], "roles")
    d = candidates.withColumn("_m", E.text_bool("is_match"))
    found = d.where("_m").select("injection_id").distinct()
    d = d.join(found, "injection_id", "left_semi").join(roles.select("injection_id", *split_columns, F.lit(1).alias("_role")), "injection_id", "left")
    target = E.harmonic_name(E.nearest_supported_factor("harmonic_factor", tol))
    d = cut_lineage(d.withColumn("_h", F.when(F.col("_m"), F.coalesce(target, F.lit(""))).otherwise("")))
    _refuse(d.where("_role IS NULL").select("review_id", "injection_id"), "candidates outside the schedule")
    _refuse(d.where("_m AND _h = ''").select("review_id", "harmonic_factor"), "matches with an unsupported factor")
    variant = lambda name: F.struct(F.lit(name).alias("v"))
    d = d.withColumn("_v", F.explode(F.when(F.col("_m"), F.array(variant("injected"), variant("paired_original"))).otherwise(F.array(variant("injected")))))
    positive = F.col("_m") & (F.col("_v.v") == "injected")
    d = d.withColumns({
        "input_variant": F.col("_v.v"), "review_id": F.when(F.col("_v.v") == "injected", F.col("review_id").cast("string")).otherwise(F.concat(F.col("review_id").cast("string"), F.lit(":paired_original"))),
        "training_role": F.when(positive, "compact_positive").when(F.col("_m"), "paired_pre_injection").otherwise("same_lc_unmatched_peak"),
        "compact_target_index": positive.cast("int"), "harmonic_target": F.when(positive, F.col("_h")).otherwise("")})
    return d.withColumns({"harmonic_target_index": E.class_index("harmonic_target", K.HARMONIC_NAMES), "is_injected_row": F.lit(True)}).drop("_m", "_role", "_h", "_v")


def human_rows(rows: DataFrame, morphology: Sequence[str], preserve: Sequence[str], transfer: DataFrame | None = None, key: str = "review_id") -> DataFrame:
    """Real labelled rows that supervise at least one task, with the class index of each task (-1: not supervised).

    Out: injected rows, rows whose transfer did not pass, rows without a label, signals whose ephemeris is unresolved, and rows
    without an active target. Repeats of an id in ``transfer`` count as passed only if all passed.
    """
    injected = E.text_bool("is_injected_row") if "is_injected_row" in rows.columns else F.coalesce(F.lower("source_kind").contains("inject"), F.lit(False))
    d = rows.where(~injected)
    if transfer is not None:
        ok = transfer.groupBy(key).agg(F.bool_and(E.text_bool("transfer_ok")).alias("_ok")).where("_ok").select(key)
        d = d.join(ok, key, "left_semi")
    unresolved = _text("ephemeris_status") == "unresolved"
    d = d.where(_trainable("human_label") & ~(unresolved & F.col("human_label").isin(*SIGNALS)))
    has = F.lit(True) if "harmonic_include" not in d.columns else E.text_bool("harmonic_include")
    d = d.withColumns({"morphology_target_index": E.class_index(_text("morphology_target"), morphology), "preserve_target_index": E.class_index(_text("preserve_target"), preserve),
                       "harmonic_target_index": E.class_index(_text("harmonic_target"), K.HARMONIC_NAMES, has)})
    active = (F.col("morphology_target_index") >= 0) | (F.col("preserve_target_index") >= 0) | (F.col("harmonic_target_index") >= 0)
    return d.where(active).withColumns({"training_role": F.lit("real_human_morphology"), "input_variant": F.lit("observed"), "is_injected_row": F.lit(False)})


def fold_weights(rows: DataFrame, fit: Column, tasks: dict[str, str], cap: float = 4.0, share: float = 0.25, equal_label: str = "planet_like") -> DataFrame:
    """Weights of each task (target index column -> weight column) from the fit rows alone; other rows weigh 0.

    A class weighs min(cap, sqrt(largest / its rows)), mean 1. Injected rows of a class then hold at most the total of its real
    rows, for other labels than ``equal_label`` a share of it, and the mean is 1 again. All rows of one (class, injected, label is
    equal) cell weigh the same, so the weights come from a table of at most four rows a class, joined back to the rows.
    """
    d = rows.withColumns({"_fit": F.coalesce(fit, F.lit(False)), "_i": E.text_bool("is_injected_row"), "_e": _text("human_label") == equal_label})
    for target, weight in tasks.items():
        cell = d.where(F.col("_fit") & (F.col(target) >= 0)).groupBy(target, "_i", "_e").agg(F.count(F.lit(1)).alias("n"))
        size = cell.groupBy(target).agg(F.sum("n").alias("c"))
        w = size.transform(with_row, size.agg(F.max("c").alias("top"))).withColumn("w", F.least(F.lit(cap), F.sqrt(F.col("top") / F.col("c"))))
        w = w.transform(with_row, w.agg((F.sum(F.col("w") * F.col("c")) / F.sum("c")).alias("m"))).select(target, (F.col("w") / F.col("m")).alias("w"))
        cell = cell.join(w, target)
        real = cell.where("NOT _i").groupBy(target).agg(F.sum(F.col("w") * F.col("n")).alias("real"))
        limit = F.when(F.col("_e"), F.col("real")).otherwise(share * F.col("real"))
        total = F.col("w") * F.col("n")
        cell = cell.join(real, target, "left").withColumn("w", F.when(F.col("_i") & (total > limit), F.col("w") * limit / total).otherwise(F.col("w")))
        mean = cell.where("w > 0").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("m"))
        cell = cell.transform(with_row, mean).select(target, "_i", "_e", (F.col("w") / F.col("m")).alias("_w"))
        d = d.drop(weight).join(cell, [target, "_i", "_e"], "left").withColumn(weight, F.when(F.col("_fit"), F.coalesce("_w", F.lit(0.0))).otherwise(0.0)).drop("_w")
    return d.drop("_fit", "_i", "_e")


def score_problems(truth: DataFrame, scores: DataFrame, classes: Sequence[str], key: str = "review_id") -> DataFrame:
    """(key, problem): truth rows without a score, repeated or empty ids, probabilities that are missing or do not sum to one."""
    p = [F.col(f"p_{c}").cast("double") for c in classes]
    fine = F.lit(True)
    for c in p:
        fine = fine & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    total = p[0]
    for c in p[1:]:
        total = total + c
    s = scores.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(fine).alias("_f"), F.max(F.abs(total - 1)).alias("_d"))
    d = truth.select(key).distinct().withColumn("_t", F.lit(1)).join(s, key, "full")
    problem = (F.when(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", "empty_id").when(F.col("_n") > 1, "repeated_id").when(F.col("_n").isNull(), "no_score")
               .when(~F.col("_f"), "not_finite").when(F.col("_d") > 1.0e-4, "sum_not_one"))
    return d.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def locked_rows(rows: DataFrame, new: DataFrame, old: DataFrame, classes: Sequence[str], key: str = "review_id") -> DataFrame:
    """The locked test rows with the class that either score table predicts (the first class among equals)."""
    locked = (F.col("fixed_split") == "test") & (F.col("training_role") == "real_human_morphology") & (F.col("morphology_target_index") >= 0)
    truth = rows.where(locked).select(key, F.element_at(F.array(*[F.lit(c) for c in classes]), (F.col("morphology_target_index") + 1).cast("int")).alias("label"))
    assert_unique(truth, [key], "locked rows")
    if truth.isEmpty():
        raise ValueError("no locked rows with an active target")
    for name, s in (("new", new), ("old", old)):
        _refuse(score_problems(truth, s, classes, key), f"{name} scores")
        p = M.score_predictions(s.select(key, *[f"p_{c}" for c in classes]), {c: f"p_{c}" for c in classes})
        truth = truth.join(p.select(key, F.col("predicted").alias(f"{name}_predicted"), F.col("confidence").alias(f"{name}_confidence")), key)
    return truth


def compare_locked(joined: DataFrame, required: Sequence[str], max_decline: float = 0.03, min_recall: float = 0.60) -> DataFrame:
    """One row: macro-F1 of both score tables on the same rows, the least required recall of the new one, and the acceptance."""
    per = {n: M.class_metrics(M.confusion(joined, "label", f"{n}_predicted"), "label", f"{n}_predicted") for n in ("new", "old")}
    macro = {n: M.summary_metrics(per[n]).select(F.col("macro_f1").alias(f"{n}_macro_f1")) for n in per}
    have = per["new"].where(F.col("label").isin(*required) & (F.col("support") > 0))
    low = have.agg(F.count(F.lit(1)).alias("_k"), F.min("recall").alias("min_required_recall"))
    d = joined.agg(F.count(F.lit(1)).alias("n")).transform(with_row, macro["new"]).transform(with_row, macro["old"]).transform(with_row, low)
    d = d.withColumn("delta", F.col("new_macro_f1") - F.col("old_macro_f1"))
    return d.withColumns({"macro_f1_holds": F.coalesce(F.col("delta") >= -max_decline, F.lit(False)),
                          "recall_holds": (F.col("_k") == len(required)) & F.coalesce(F.col("min_required_recall") >= min_recall, F.lit(False))}).withColumn(
        "passed", F.col("macro_f1_holds") & F.col("recall_holds")).drop("_k")
