"""Streaming twins of the label, session, noise-bin and arrival operators."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumensift.operators.skew import with_row

LATEST = "row_id bigint, label string, updated_utc timestamp, seq bigint"
STATE = "label string, updated_us bigint, seq bigint"


def latest_label_stream(log: DataFrame, ttl_ms: int | None = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Newest label per row id, emitted whenever it changes (update mode).

    State holds one record per row and expires after ``ttl_ms`` without news. An older record that comes after that is emitted again, so
    readers merge by (time, seq), as ``as_of`` does, and never by arrival. Records without a time count as oldest. ``ttl_ms=None`` keeps state for good (bounded replays).
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = tuple(state.get) if state.exists else None
        start = best
        for pdf in batches:
            us = pdf["updated_utc"].map(lambda t: -1 if pd.isna(t) else int(pd.Timestamp(t).value // 1000))
            for label, u, s in zip(pdf["label"], us, pdf["seq"]):
                if best is None or (u, int(s)) > (best[1], best[2]):
                    best = (label, int(u), int(s))
        state.update(best)
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        if best != start:
            when = pd.Series([pd.NaT if best[1] < 0 else pd.Timestamp(best[1] * 1000)], dtype="datetime64[ns]")
            yield pd.DataFrame({"row_id": [key[0]], "label": [best[0]], "updated_utc": when, "seq": [best[2]]})

    return log.select("row_id", "label", F.col("updated_utc").cast("timestamp").alias("updated_utc"), "seq").groupBy("row_id").applyInPandasWithState(
        step, LATEST, STATE, "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def gap_session_stream(cadences: DataFrame, gap: str = "12 hours", watermark: str = "1 day") -> DataFrame:
    """Stretches of a target's cadences separated by longer gaps (event time ``ts``)."""
    return cadences.withWatermark("ts", watermark).groupBy("tic", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")) \
        .select("tic", F.col("session_window.start").alias("t_start"), F.col("session_window.end").alias("t_end"), "n")


def noise_bin_stream(cadences: DataFrame, width: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Approximate medians in epoch-aligned windows; the batch operator starts its bins at the first cadence instead."""
    return cadences.withWatermark("ts", watermark).groupBy("tic", F.window("ts", width)).agg(F.percentile_approx("flux", 0.5, 10000).alias("median_flux"), F.count(F.lit(1)).alias("n")) \
        .select("tic", F.col("window.start").alias("t_start"), "median_flux", "n")


def arrival_stream(arrivals: DataFrame) -> DataFrame:
    """Distinct arrived targets per sector and orbit (complete mode): repeats are dropped by state, counts are exact."""
    return arrivals.select("sector", "orbit", "tic").dropDuplicates().groupBy("sector", "orbit").agg(F.count(F.lit(1)).alias("n_arrived"))


def against_expected(arrived: DataFrame, expected: DataFrame) -> DataFrame:
    """Every expected cell beside what has arrived there, none included."""
    e = expected.groupBy("sector", "orbit").agg(F.count(F.lit(1)).alias("n_expected"))
    d = e.join(arrived, ["sector", "orbit"], "full_outer")
    return d.select("sector", "orbit", F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_arrived", F.lit(0)).alias("n_arrived"))


def merge_latest(target: str):
    """foreachBatch writer: changes go to one folder per epoch, overwritten on a retry, so a batch counts once."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
    return write


def as_of(target: DataFrame) -> DataFrame:
    """Current state of the appended latest-label table: the newest record of each row, whichever batch brought it."""
    rest = [c for c in target.columns if c != "row_id"]
    return target.groupBy("row_id").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("updated_utc", F.lit(datetime(1970, 1, 1))), "seq", "epoch")).alias("r")).select("row_id", "r.*")


def last_epoch(target: DataFrame) -> DataFrame:
    """The newest whole result of a stream in complete mode."""
    return with_row(target, target.agg(F.max("epoch").alias("_last"))).where("epoch = _last").drop("epoch", "_last")
