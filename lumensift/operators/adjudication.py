"""Adjudication as an event-sourced fold.

Every saved decision is an event of one source: its original review, its blind repeat or a third pass. A source's state is the
newest record of each of the three, so states merge: any prefix folded first and continued later gives the state of the whole
log, and each task sends one row per source however many events a source has. ``replay`` gives the state after each event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions import exprs as E
from lumensift.functions.hashing import digest
from lumensift.operators import labels as L, ordered, skew
from lumensift.operators.ordering import with_global_row_number

#: What a decision is about; a source reviewed once has only the first.
SLOTS = ("original", "blind_repeat", "resolution")
#: States with a decision.
FINAL = ("single_review", "blind_repeat_agreement", "third_pass_resolution")
#: Labels that claim a signal.
SIGNALS = ("planet_like", "eclipsing_binary_or_pceb", "wide_transit_like", "stellar_variability")
#: Order of events of one source: missing times are oldest, then the pass, then the position in its log.
ORDER = ("at", "pass_no", "seq")


def _text(c) -> Column:
    return F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))


def review_load(queue: DataFrame, log: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows beside their newest label, period factor and status; rows and keys must agree one to one.

    ``queue``: row_id, candidate_key. ``log``: row_id, seq, updated_utc, label, period_factor. ``manifest``: row_id, candidate_key,
    source_uid, review_period_d. Rows without a label keep empty factor and status and a NULL period.
    """
    skew.assert_unique(manifest, ["row_id"], "manifest")
    skew.assert_unique(queue, ["row_id"], "queue")
    both = queue.select("row_id", F.col("candidate_key").alias("_qk"), F.lit(True).alias("_q")).join(
        manifest.select("row_id", F.col("candidate_key").alias("_mk"), F.col("source_uid").alias("_u"), F.lit(True).alias("_m")), "row_id", "full_outer")
    skew.require(both, F.col("_q") & F.col("_m") & F.col("_u").isNotNull() & F.col("_qk").eqNullSafe(F.col("_mk")), "manifest and queue disagree")
    newest = L.latest_labels(log)
    if not newest.join(queue, "row_id", "left_anti").isEmpty():
        raise ValueError("labels name rows that the queue lacks")
    j = manifest.join(newest.select("row_id", _text("label").alias("label"), E.button_factor("period_factor").alias("_b")), "row_id", "left")
    has = _text("label") != ""
    skew.require(j, ~has | F.col("_b.factor_text").isNotNull(), "unknown period factor")
    return j.withColumns({"label": _text("label"), "period_factor": F.when(has, F.col("_b.factor_text")).otherwise(""), "period_status": F.when(has, F.col("_b.status")).otherwise(""),
                          "period_d": F.when(has, F.col("review_period_d") * F.col("_b.factor"))}).drop("_b")


def events_of(log: DataFrame, manifest: DataFrame, third: DataFrame | None = None) -> DataFrame:
    """One event per log record: source_uid, slot, at (days), pass_no, seq, label, factor.

    ``manifest``: row_id, source_uid, occurrence (single, original, blind_repeat). ``third``: source_uid, seq, updated_utc, label,
    period_factor of the third pass.
    """
    days = (F.unix_micros(F.col("updated_utc").cast("timestamp")) / 8.64e10).alias("at")
    shape = lambda slot, n: (F.col("source_uid"), slot.alias("slot"), days, F.lit(n).alias("pass_no"), F.col("seq"), _text("label").alias("label"),
                             E.button_factor("period_factor")["factor_text"].alias("factor"))
    slot = F.when(F.col("occurrence") == "blind_repeat", "blind_repeat").otherwise("original")
    e = log.join(manifest.select("row_id", "source_uid", "occurrence"), "row_id").select(*shape(slot, 1))
    return e if third is None else e.unionByName(third.select(*shape(F.lit("resolution"), 2)))


def _record() -> Column:
    return F.struct(*ORDER, "label", "factor")


def fold(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """State per source: the newest record of each slot (blank labels too: they take a decision back) and the number of events.

    ``before`` is the state of earlier events. The events may come in any order and in any number of batches.
    """
    e = events.select("source_uid", *[F.when(F.col("slot") == s, _record()).alias(s) for s in SLOTS], F.lit(1).cast("bigint").alias("n_events"))
    if before is not None:
        e = e.unionByName(before.select("source_uid", *SLOTS, "n_events"))
    return e.groupBy("source_uid").agg(*[F.max(s).alias(s) for s in SLOTS], F.sum("n_events").alias("n_events"))


def state_name(n_rows: Column) -> Column:
    """Name of the state that the newest records of the slots make, for a source with that many queue rows."""
    a, b, t = (F.coalesce(F.col(f"{s}.label"), F.lit("")) for s in SLOTS)
    same = (a == b) & F.col("original.factor").eqNullSafe(F.col("blind_repeat.factor"))
    pair = (F.when((a == "") & (b == ""), "unreviewed").when((a == "") | (b == ""), "half_reviewed").when(same, "blind_repeat_agreement")
            .when(t != "", "third_pass_resolution").otherwise("discordant"))
    return F.when(n_rows == 1, F.when(a == "", "unreviewed").otherwise("single_review")).when(n_rows == 2, pair).otherwise("invalid")


def _rows_per_source(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("source_uid").agg(F.count(F.lit(1)).alias("n_rows"), F.min("review_period_d").alias("review_period_d"))


def decisions(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """One row per source of the manifest: state, final label, factor, status and period; sources without events are unreviewed."""
    j = _rows_per_source(manifest).join(state, "source_uid", "left").withColumn("state", state_name(F.col("n_rows")))
    last = F.when(F.col("state") == "third_pass_resolution", F.col("resolution")).when(F.col("state").isin(*FINAL), F.col("original"))
    j = j.withColumn("_l", last).withColumn("_b", F.when(F.col("_l").isNotNull(), E.button_factor("_l.factor")))
    return j.select("source_uid", "n_rows", F.coalesce("n_events", F.lit(0)).alias("n_events"), "state", F.col("_l").isNotNull().alias("is_final"),
                    _text("_l.label").alias("final_label"), _text("_b.factor_text").alias("final_factor"), _text("_b.status").alias("final_status"),
                    (F.col("review_period_d") * F.col("_b.factor")).alias("final_period_d"))


def replay(events: DataFrame, manifest: DataFrame, hot: bool = False, chunk_d: float = 1.0) -> DataFrame:
    """The state after every event in order. ``hot`` runs a source's log in chunks of time that hand one record per slot on."""
    d = events
    for s in SLOTS:
        d = ordered.with_neighbours(d, ["source_uid"], list(ORDER), F.when(F.col("slot") == s, _record()), f"_{s}", "_after", hot, chunk_d).drop("_after")
    d = d.withColumnsRenamed({f"_{s}": s for s in SLOTS})
    j = d.join(manifest.groupBy("source_uid").agg(F.count(F.lit(1)).alias("_n")), "source_uid")
    return j.select("source_uid", *ORDER, "slot", "label", state_name(F.col("_n")).alias("state"))


def resolution_queue(manifest: DataFrame, decided: DataFrame, public: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Discordant pairs for a third pass, in the order of their repeat groups: public rows (``public`` columns only) and the hidden manifest."""
    open_ = decided.where("state = 'discordant'").select("source_uid")
    d = manifest.where("occurrence = 'original'").join(open_, "source_uid", "left_semi")
    d = with_global_row_number(d, [F.col("repeat_group"), F.col("source_uid")], "_p").withColumn("row_id", F.col("_p") - 1).drop("_p")
    d = d.withColumn("review_id", F.format_string("resolution:%03d", "row_id"))
    return d.select("row_id", "review_id", *public), d.select("row_id", "review_id", "source_uid", "repeat_group")


def adjudicated_table(sources: dict[str, DataFrame], decided: DataFrame) -> DataFrame:
    """Labelled rows of all sources under unique ``<source>:<review_id>`` ids, final decisions laid over labels and ephemerides.

    A source without a final decision keeps its label and period; an unresolved period keeps the period and is flagged.
    """
    u = None
    for name, df in sources.items():
        one = df.withColumns({"source_uid": F.concat_ws(":", F.lit(name), F.col("review_id").cast("string")), "label_raw": _text("label")}).where("label_raw <> ''")
        u = one if u is None else u.unionByName(one, allowMissingColumns=True)
    skew.assert_unique(u, ["source_uid"], "adjudicated table")
    d = u.join(decided.where("is_final").select("source_uid", "state", "final_label", "final_factor", "final_status", "final_period_d"), "source_uid", "left")
    done = F.col("state").isNotNull()
    refold = done & (F.col("final_status") != "unresolved")
    open_ = done & (F.col("final_status") == "unresolved")
    label = F.when(done, F.col("final_label")).otherwise(F.col("label_raw"))
    d = d.withColumns({"label": label, "decision_source": F.coalesce("state", F.lit("")), "model_period_d": F.when(refold, F.col("final_period_d")).otherwise(F.col("period_d")),
                       "model_ephemeris_source": F.when(refold, "human_adjudicated_harmonic").otherwise("current_search"),
                       "harmonic_suspect": done & ((F.col("final_factor") != "1") | open_), "refold_factor": F.col("final_factor").try_cast("double"),
                       "ephemeris_status": F.coalesce("final_status", F.lit(""))})
    keep = ~F.col("label").isin("", "skip")
    return d.withColumns({"preserve_include": keep, "compact_include": (E.label_target("label") != "") & (F.col("label") != "uncertain") & ~(open_ & F.col("label").isin(*SIGNALS))}) \
        .drop("state", "final_label", "final_factor", "final_status", "final_period_d")


def pool_quartile(df: DataFrame, pool: Sequence[str], value: str, key: str, out: str, limit: int | None = None) -> DataFrame:
    """Quartile by rank inside each pool (ties by ``key``), 'missing' without a finite value.

    One order over (pool, value) serves all pools, so a pool that holds most rows is cut into ranges like any table.
    """
    v = F.col(value).cast("double")
    d = df.withColumn("_v", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))
    order = [*[F.col(p) for p in pool], F.col("_v").isNull(), F.coalesce("_v", F.lit(0.0)), F.col(key)]
    d = with_global_row_number(d, order, "_p", limit)
    n = d.groupBy(*pool).agg(F.min("_p").alias("_first"), F.count("_v").alias("_n"))
    d = d.join(n, list(pool))
    bin_ = F.least(F.floor(4 * (F.col("_p") - F.col("_first")) / F.col("_n")), F.lit(3).cast("bigint")) + 1
    return d.withColumn(out, F.when(F.col("_v").isNull(), "missing").otherwise(F.concat(F.lit("q"), bin_.cast("string")))).drop("_v", "_p", "_first", "_n")


def stratified_controls(df: DataFrame, pool: Sequence[str], n: int, seed: int, key: str, values: Sequence[str], extra: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """``n`` rows of each pool, dealt round by round over its strata (quartiles of ``values``, and ``extra`` columns) in hash order."""
    d = df
    for v in values:
        d = pool_quartile(d, pool, v, key, f"{v}_quartile", limit)
    d = d.withColumn("control_stratum", F.concat_ws("|", *[f"{v}_quartile" for v in values], *extra)).withColumns({
        "_h": digest(F.col(key).cast("string"), seed), "_s": digest(F.col("control_stratum"), seed + 1)})
    # no row beyond round n can be among the first n of its pool; both rank filters are cut before the shuffle
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(*pool, "control_stratum").orderBy("_h", key))).where(F.col("_r") <= n)
    d = d.withColumn("_t", F.row_number().over(W.partitionBy(*pool).orderBy("_r", "_s", "_h", key))).where(F.col("_t") <= n)
    return d.drop("_h", "_s", "_r", "_t")


def adjudication_queue(first: DataFrame, active: DataFrame, cohorts: dict[str, DataFrame], controls: Sequence[str], n_controls: int, seed: int,
                       values: Sequence[str] = ("period_d", "tmag", "sde_max"), limit: int | None = None) -> DataFrame:
    """Every row that was ever called a signal, plus stratified controls of targets without one; one row per source.

    ``first`` and ``active`` (review_id, tic, origin, label, ...) are the labels as first given and as they are now; the row itself
    comes from ``active``. ``cohorts`` are further signal tables. Controls: ``n_controls`` per origin and label of ``controls``.
    """
    sig = lambda c: _text(c).isin(*SIGNALS)
    one = first.select("review_id", _text("label").alias("first_label"))
    skew.assert_unique(one, ["review_id"], "first labels")
    skew.assert_unique(active, ["review_id"], "active labels")
    lost = one.where(sig("first_label")).join(active, "review_id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"signal rows missing from the active table: {[r[0] for r in lost]}")
    a = active.withColumns({"label": _text("label"), "origin": _text("origin")}).join(one, "review_id", "left")
    a = a.withColumns({"first_label": F.coalesce("first_label", "label"), "source_uid": F.concat(F.lit("teacher:"), F.col("review_id").cast("string"))})
    was = sig("first_label") | sig("label")
    s = a.where(was).withColumns({"cohort": F.lit("historical_signal"), "historical_label": F.when(sig("first_label"), F.col("first_label")).otherwise(F.col("label"))})
    for name, df in cohorts.items():
        c = df.where(sig("label")).withColumns({"label": _text("label"), "cohort": F.lit(name), "historical_label": _text("label"),
                                                "source_uid": F.concat_ws(":", F.lit(name), F.col("review_id").cast("string"))})
        s = s.unionByName(c, allowMissingColumns=True)
    pool = a.where(~was & F.col("label").isin(*controls)).join(s.select("tic").distinct(), "tic", "left_anti")
    picked = stratified_controls(pool, ["origin", "label"], n_controls, seed, "review_id", values, limit=limit).withColumns({"cohort": F.lit("control"), "historical_label": F.lit("")})
    out = s.unionByName(picked, allowMissingColumns=True)
    return skew.assert_unique(out, ["source_uid"], "adjudication queue")
