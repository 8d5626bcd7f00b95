"""Box spectra of two apertures of one target on one logarithmic grid.

Both apertures share the cadences, the time zero and the trial periods, so a period is folded once: a cadence's bin serves both,
and each aperture's sums go to its own array. A target's cadences are cut into blocks of bounded length. A target of one block is
sent once per large chunk of periods. A target of many blocks is sent once per small chunk; the blocks of a chunk stream through
one task, which adds integer sums into arrays of (period, bin). A target of any size is thus many tasks of bounded memory, and as
the sums are integers the winners depend neither on blocks nor on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lumensift.functions import consts as K
from lumensift.operators import robust
from lumensift.operators.search import UNIT

APERTURES = ("small", "primary")
SPECTRUM = "tic bigint, period_idx bigint, period_d double, power_small double, power_primary double"


@dataclass(frozen=True)
class SharedGrid:
    """Grid, boxes and cuts; the defaults are the survey's."""

    n_periods: int = 4096
    p_min_d: float = K.P_MIN_D
    p_max_d: float = K.P_MAX_CAP_D
    durations_min: tuple[float, ...] = K.SEARCH_DURATIONS_MIN
    min_cadences: int = K.MIN_CADENCES
    sigma_clip: float = K.UPPER_CLIP_SIGMA
    block_rows: int = 50_000
    chunk_periods: int = 1024
    cells: int = 2_000_000

    def periods(self, lo: int, hi: int) -> np.ndarray:
        """Trial periods lo to hi - 1, rounded to nanodays so that every engine folds on the same numbers."""
        step = (log(self.p_max_d) - log(self.p_min_d)) / (self.n_periods - 1)
        return np.floor(np.exp(log(self.p_min_d) + np.arange(lo, hi) * step) * 1e9 + 0.5) / 1e9

    def widths(self) -> tuple[float, list[int]]:
        """Bin width in days and the distinct box lengths in bins."""
        w = min(self.durations_min) / K.MIN_PER_DAY
        return w, sorted({max(1, round(d / K.MIN_PER_DAY / w)) for d in self.durations_min})

    def bins(self) -> int:
        return ceil((self.p_max_d + 1e-9) / self.widths()[0])


def paired(cadences: DataFrame, small: str, primary: str) -> DataFrame:
    """One row per target and cadence with both fluxes (NULL where an aperture lacks it); the worse quality counts."""
    at = lambda a: F.max(F.when(F.col("aperture") == a, F.col("flux")))
    return cadences.where(F.col("aperture").isin(small, primary)).groupBy("tic", "cadenceno").agg(
        F.min("time").alias("time"), F.max("quality").alias("quality"), at(small).alias("flux_small"), at(primary).alias("flux_primary"))


def masked(pairs: DataFrame, grid: SharedGrid, hot: bool = False) -> DataFrame:
    """(tic, time, q_small, q_primary): integer flux residuals, NULL where a cadence is out for that aperture.

    Good cadences have quality 0, a finite time and a finite flux. Fluxes are divided by their median; bright outliers go unless
    too few rows would stay. An aperture with too few good cadences or a zero median has no rows.
    """
    key = ["tic"]
    d = pairs.where((F.col("quality") == 0) & robust.finite(F.col("time")))
    for a in APERTURES:
        f = robust.finite_or_null(F.col(f"flux_{a}"))
        d = robust.with_median(d.withColumn(f"f_{a}", f), key, F.col(f"f_{a}"), f"m_{a}", hot)
        d = robust.with_count(d, key, F.col(f"f_{a}").isNotNull(), f"n_{a}", hot)
        ok = (F.col(f"n_{a}") >= grid.min_cadences) & (F.abs(f"m_{a}") >= 1e-12)
        d = d.withColumn(f"y_{a}", F.when(ok, F.col(f"f_{a}") / F.nullif(f"m_{a}", F.lit(0.0))))
        d = robust.with_median(d, key, F.abs(F.col(f"y_{a}") - 1), f"s_{a}", hot)
        keep = (F.col(f"y_{a}") - 1) <= F.lit(grid.sigma_clip * K.MAD_SIGMA) * F.col(f"s_{a}")
        d = robust.with_count(d, key, keep, f"k_{a}", hot)
        clip = (F.col(f"s_{a}") > 0) & (F.col(f"k_{a}") >= grid.min_cadences)
        d = d.withColumn(f"q_{a}", F.when(~clip | keep, F.rint((F.col(f"y_{a}") - 1) * UNIT).cast("bigint")))
    return d.select("tic", "time", "q_small", "q_primary").where("q_small IS NOT NULL OR q_primary IS NOT NULL")


def _sums(t: np.ndarray, values: list[np.ndarray], keep: list[np.ndarray], periods: np.ndarray, w: float, n_bins: int) -> np.ndarray:
    """Counts and sums per aperture, period and bin: shape (aperture, 2, period, bin)."""
    p = periods.size
    out = np.zeros((2, 2, p, n_bins), np.int64)
    step = max(1, 400_000 // max(1, t.size))
    for a in range(0, p, step):
        b = min(p, a + step)
        at = np.floor(np.mod(t[None, :], periods[a:b, None]) / w).astype(np.int64) + np.arange(b - a)[:, None] * n_bins
        for k in range(2):
            cell = at[:, keep[k]].ravel()
            out[k, 0, a:b] = np.bincount(cell, minlength=(b - a) * n_bins).reshape(b - a, n_bins)
            # a block's sums stay below 2 ** 53, so doubles hold them exactly
            out[k, 1, a:b] = np.bincount(cell, np.tile(values[k], b - a), (b - a) * n_bins).reshape(b - a, n_bins).astype(np.int64)
    return out


def _power(n: np.ndarray, s: np.ndarray, periods: np.ndarray, w: float, boxes: list[int], n_all: int, s_all: int) -> np.ndarray:
    """Largest likelihood gain over boxes that start at an occupied bin and wrap at most once; NaN where no box dims."""
    p, n_bins = n.shape
    own = np.ceil(periods / w).astype(np.int64)[:, None]
    pos = np.arange(n_bins + boxes[-1] - 1)[None, :]
    src = np.where(pos < own, pos, pos - own)
    live = (pos < own) | (src < boxes[-1] - 1)
    src = np.minimum(src, n_bins - 1)
    run = lambda x: np.concatenate([np.zeros((p, 1), np.int64), np.cumsum(np.where(live, np.take_along_axis(x, src, 1), 0), axis=1)], axis=1)
    cn, cs = run(n), run(s)
    best = np.full(p, -1.0)
    for k in boxes:
        n_in, s_in = cn[:, k:k + n_bins] - cn[:, :n_bins], cs[:, k:k + n_bins] - cs[:, :n_bins]
        ok = (n > 0) & (n_in < n_all)
        depth = ((s_all - s_in) / np.where(ok, n_all - n_in, 1) - s_in / np.maximum(n_in, 1)) / UNIT
        best = np.maximum(best, np.where(ok & (depth > 0), 0.5 * n_in * depth * depth, -1.0).max(axis=1))
    return np.where(best > 0, best, np.nan)


def shared_power(rows: DataFrame, targets: DataFrame, grid: SharedGrid) -> DataFrame:
    """Power of both apertures at every trial period of every target; targets without usable rows have NULL powers."""
    w, boxes = grid.widths()
    n_bins, n = grid.bins(), grid.n_periods
    count = lambda a: F.count(f"q_{a}").alias(f"n_{a}")
    total = lambda a: F.coalesce(F.sum(f"q_{a}"), F.lit(0)).alias(f"s_{a}")
    stats = rows.groupBy("tic").agg(F.min("time").alias("t_min"), F.count(F.lit(1)).alias("_n"), *[count(a) for a in APERTURES], *[total(a) for a in APERTURES])
    stats = targets.select("tic").distinct().join(stats, "tic", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("_n") / grid.block_rows), F.lit(0)))
    block = F.pmod(F.xxhash64("time", "q_small", "q_primary"), F.greatest(F.col("blocks"), F.lit(1)))
    packed = rows.join(stats.select("tic", "blocks"), "tic").groupBy("tic", block.alias("block")).agg(F.collect_list(F.struct("time", "q_small", "q_primary")).alias("c"))
    d = stats.join(packed, "tic", "left")
    small_step, big_step = max(1, min(grid.chunk_periods, grid.cells // n_bins)), grid.chunk_periods
    step = F.when(F.col("blocks") > 1, small_step).otherwise(big_step)
    d = d.withColumn("step", step).withColumn("lo", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.col("step"))))
    d = d.select("tic", "t_min", "blocks", "step", "lo", *[f"{x}_{a}" for x in "ns" for a in APERTURES],
                 F.col("c.time").alias("ts"), F.col("c.q_small").alias("q0"), F.col("c.q_primary").alias("q1"))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    d = d.repartition(tasks, "tic", "lo").sortWithinPartitions("tic", "lo")

    def frame(row, lo: int, periods: np.ndarray, sums: np.ndarray | None) -> pd.DataFrame:
        out = {"tic": row.tic, "period_idx": np.arange(lo, lo + periods.size), "period_d": periods}
        for k, a in enumerate(APERTURES):
            n_all = 0 if sums is None else int(getattr(row, f"n_{a}"))
            out[f"power_{a}"] = _power(sums[k, 0], sums[k, 1], periods, w, boxes, n_all, int(getattr(row, f"s_{a}"))) if n_all else np.full(periods.size, np.nan)
        return pd.DataFrame(out)

    def sums_of(row, periods: np.ndarray) -> np.ndarray:
        t = np.asarray(row.ts, dtype=np.float64) - row.t_min
        cols = [np.asarray(q, dtype=np.float64) for q in (row.q0, row.q1)]  # NULL arrives as NaN
        keep = [~np.isnan(q) for q in cols]
        return _sums(t, [q[k] for q, k in zip(cols, keep)], keep, periods, w, n_bins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_row, periods, acc = None, None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if open_row is not None and (open_row.tic, open_row.lo) != (row.tic, row.lo):
                    yield frame(open_row, int(open_row.lo), periods, acc)
                    open_row = None
                if row.blocks > 1:
                    if open_row is None:
                        open_row, periods = row, grid.periods(row.lo, min(n, row.lo + row.step))
                        acc = np.zeros((2, 2, periods.size, n_bins), np.int64)
                    acc += sums_of(row, periods)
                    continue
                for lo in range(row.lo, min(n, row.lo + row.step), small_step):
                    part = grid.periods(lo, min(n, row.lo + row.step, lo + small_step))
                    yield frame(row, lo, part, sums_of(row, part) if row.blocks else None)
        if open_row is not None:
            yield frame(open_row, int(open_row.lo), periods, acc)

    spec = d.mapInPandas(run, SPECTRUM)
    return spec.withColumns({f"power_{a}": F.when(~F.isnan(f"power_{a}"), F.col(f"power_{a}")) for a in APERTURES})


def shared_spectrum(cadences: DataFrame, small: str, primary: str, grid: SharedGrid = SharedGrid(), hot: bool = False) -> DataFrame:
    """(tic, period_idx, log_period, power and SDE of both apertures); a window holds one target's grid, whose size is a setting.

    SDE is the robust z-score of power over the grid: MAD scale, the standard deviation where that is 0, else 0.
    """
    pairs = paired(cadences, small, primary)
    d = shared_power(masked(pairs, grid, hot), pairs, grid)
    w = W.partitionBy("tic")
    for a in APERTURES:
        d = d.withColumn("_x", F.col(f"power_{a}") - F.median(f"power_{a}").over(w))
        d = d.withColumn("_d", F.median(F.abs("_x")).over(w)).withColumn("_s", F.stddev_pop("_x").over(w))
        z = (F.when(F.col("_d") > 0, F.col("_x") / F.nullif(F.lit(K.MAD_SIGMA) * F.col("_d"), F.lit(0.0)))
             .when(F.col("_s") > 0, F.col("_x") / F.nullif("_s", F.lit(0.0))).when(F.col("_x").isNotNull(), F.lit(0.0)))
        d = d.withColumn(f"sde_{a}", z)
    return d.drop("_x", "_d", "_s").withColumn("log_period", F.log10("period_d"))
