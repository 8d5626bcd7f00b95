"""Box-shaped periodic search over a frequency-uniform grid.

Both plans share one definition. Flux minus one becomes an integer (1e-9 units), so every
box sum is exact and the winning box does not depend on partitioning or retries. For each trial
period the rows are folded into bins one minimum duration wide; boxes of each duration start at an
occupied bin and may wrap once around the cycle; the box with the largest likelihood gain wins,
shorter and earlier boxes first among equals.

* ``spectrum_binned`` sums (curve, period, bin). With hot curves it explodes the grid and pre-aggregates map-side, which is safe
  for curves of any size and serves as the proof; otherwise tasks sum the bins of whole chunks of periods.
* ``spectrum_packed`` ships each bounded curve as two arrays, once per chunk of trial periods, and
  folds whole chunks with numpy. This is the bulk plan; curves above the hot limit go to the other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators import cadence, robust, skew
from lumensift.operators.ordering import cut_lineage
from lumensift.session import hot_rows, task_count

CURVE = cadence.CURVE
UNIT = 1e9

SPECTRUM = ("tic bigint, aperture string, period_idx bigint, period_d double, power double, depth double, "
            "depth_snr double, duration_min double, t0 double, n_in bigint")

#: Rows of a curve times trial periods in one fold: bounds its work arrays, which hold each box.
FOLD_ELEMENTS = 100_000
#: The same for folds into bins; small work arrays stay in a core's cache.
BIN_ELEMENTS = 16_000


@dataclass(frozen=True)
class SearchConfig:
    """Search settings; the defaults are the survey's.

    With ``max_drift``, a curve has as many trial periods as its own length asks for (``n_periods`` or 100 at least): an event at one period
    drifts by at most so many bins over the whole curve until the next period, so no dip lies between two of them.
    """

    n_periods: int = 200_000
    max_drift: float | None = None
    p_min_d: float = K.P_MIN_D
    p_max_cap_d: float = K.P_MAX_CAP_D
    max_period_fraction: float = K.MAX_PERIOD_FRACTION
    durations_min: tuple[float, ...] = K.SEARCH_DURATIONS_MIN
    n_peaks: int = K.N_PEAKS
    mask_fraction: float = K.PEAK_MASK_FRACTION
    min_cadences: int = K.MIN_CADENCES
    sigma_clip: float = K.UPPER_CLIP_SIGMA
    edge_trim_d: float = 0.0
    period_bin_edges: tuple[float, ...] = ()
    max_peaks_per_bin: int = 0
    chunk_periods: int = 4096

    def widths(self) -> tuple[float, list[tuple[int, float]]]:
        """Bin width in days and (bins, duration in minutes) per distinct box."""
        w = min(self.durations_min) / K.MIN_PER_DAY
        boxes = {}
        for d in sorted(self.durations_min):
            boxes.setdefault(max(1, round(d / K.MIN_PER_DAY / w)), d)
        return w, sorted(boxes.items())


def with_integer_flux(clean: DataFrame, value: str = "y") -> DataFrame:
    return clean.select(*CURVE, "time", "orbitid", F.rint((F.col(value) - 1) * UNIT).cast("bigint").alias("yq")).where("yq IS NOT NULL")


def curve_stats(q: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Per curve: count, sum, time span and grid limits; status of curves without a usable grid."""
    s = q.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("n_all"), F.sum("yq").alias("s_all"),
                              F.min("time").alias("t_min"), (F.max("time") - F.min("time")).alias("baseline_d"),
                              F.countDistinct("orbitid").alias("n_orbits"))
    return _with_status(s, cfg)


def _with_status(s: DataFrame, cfg: SearchConfig) -> DataFrame:
    p_max = F.least(F.lit(cfg.max_period_fraction) * F.col("baseline_d"), F.lit(cfg.p_max_cap_d))
    status = F.when(F.col("n_all") < cfg.min_cadences, "too_few_cadences").when(p_max <= cfg.p_min_d, "degenerate_grid").otherwise("ok")
    return s.withColumns({"p_max_d": p_max, "status": status})


def packed_curves(q: DataFrame, cfg: SearchConfig) -> DataFrame:
    """``curve_stats`` with each curve's rows as one array ``c``, by a single aggregate; for curves below the hot limit. It is written once,
    so that searches, statuses and refinements don't clean the curves anew."""
    s = q.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("time", "yq"))).alias("c"), F.count(F.lit(1)).alias("n_all"), F.sum("yq").alias("s_all"),
                              F.min("time").alias("t_min"), (F.max("time") - F.min("time")).alias("baseline_d"),
                              F.size(F.collect_set("orbitid")).cast("bigint").alias("n_orbits"))
    return cut_lineage(_with_status(s, cfg))


def grid_size(cfg: SearchConfig) -> Column:
    """Number of a curve's trial periods, from its ``p_max_d`` and ``baseline_d``; the drift is largest at the longest period."""
    n = F.lit(max(cfg.n_periods, 100)).cast("bigint")
    if cfg.max_drift is None:
        return n
    span = F.lit(1.0 / cfg.p_min_d) - F.lit(1.0) / F.col("p_max_d")
    return F.greatest(n, F.ceil(span * F.col("baseline_d") * F.col("p_max_d") / F.lit(cfg.max_drift * cfg.widths()[0])) + 1)


def grid_period(idx: Column, p_max: Column, cfg: SearchConfig, n: Column | None = None) -> Column:
    """idx-th trial period of ``n``: uniform in frequency, index 0 the shortest period."""
    steps = F.lit(float(max(cfg.n_periods, 100) - 1)) if n is None else (n - 1).cast("double")
    f_max = F.lit(1.0 / cfg.p_min_d)
    f_min = F.lit(1.0) / p_max
    return F.lit(1.0) / (f_max - idx * ((f_max - f_min) / steps))


def _best_box(n_in: Column, s_in: Column) -> tuple[Column, Column, Column]:
    n, s = F.col("n_all"), F.col("s_all")
    out = F.nullif(n - n_in, F.lit(0))
    depth = ((s - s_in) / out - s_in / n_in) / F.lit(UNIT)
    power = F.lit(0.5) * n_in * depth * depth
    snr = depth / F.sqrt(F.lit(1.0) / n_in + F.lit(1.0) / out)
    return depth, power, snr


def spectrum_binned(q: DataFrame, stats: DataFrame, cfg: SearchConfig, hot: bool = True, task_rows: int = 50_000_000) -> DataFrame:
    """Per-period maxima by bin sums of every trial period.

    With ``hot`` the grid is exploded, bins are summed before a shuffle and each (curve, period) is one sorted window, for curves of any size.
    Without, no row of the grid is made: curves are cut into chunks of periods, dealt over tasks of about ``task_rows`` rows of the grid, and
    bins are summed there.
    """
    w, boxes = cfg.widths()
    ok = stats.where("status = 'ok'").select(*CURVE, "t_min", "n_all", "s_all", "p_max_d", grid_size(cfg).alias("n_grid"))
    if not hot:
        return _spectrum_in_tasks(q, ok, cfg, task_rows)
    d = q.join(ok, CURVE)
    d = d.withColumn("period_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_grid") - 1)))
    d = d.withColumn("period_d", grid_period(F.col("period_idx"), F.col("p_max_d"), cfg, F.col("n_grid")))
    d = d.withColumn("bin", F.floor(F.pmod(F.col("time") - F.col("t_min"), F.col("period_d")) / F.lit(w)))
    key = [*CURVE, "period_idx"]
    b = d.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("yq").alias("s"), F.first("period_d").alias("period_d"),
                                   F.first("n_all").alias("n_all"), F.first("s_all").alias("s_all"), F.first("t_min").alias("t_min"))
    n_bins = F.ceil(F.col("period_d") / F.lit(w))
    k_max = boxes[-1][0]
    turns = F.when(F.col("bin") < k_max - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = b.withColumn("turn", F.explode(turns)).withColumn("pos", F.col("bin") + F.col("turn") * n_bins)
    order = W.partitionBy(*key).orderBy("pos")
    for k, _ in boxes:
        frame = order.rangeBetween(0, k - 1)
        b = b.withColumns({f"n{k}": F.sum("n").over(frame), f"s{k}": F.sum("s").over(frame)})
    b = b.where((F.col("turn") == 0))
    cands = []
    for k, dur in boxes:
        depth, power, snr = _best_box(F.col(f"n{k}"), F.col(f"s{k}"))
        good = (F.col(f"n{k}") < F.col("n_all")) & (depth > 0)
        cands.append(F.when(good, F.struct(power.alias("power"), F.lit(-k).alias("neg_k"), (-F.col("bin")).alias("neg_bin"),
                                           depth.alias("depth"), snr.alias("depth_snr"), F.lit(float(dur)).alias("duration_min"),
                                           (F.col("t_min") + (F.col("bin") + F.lit(k / 2.0)) * F.lit(w)).alias("t0"),
                                           F.col(f"n{k}").alias("n_in"))))
    best = F.array_max(F.filter(F.array(*cands), lambda c: c.isNotNull()))
    g = b.groupBy(*key).agg(F.first("period_d").alias("period_d"), F.max(best).alias("m"))
    return g.where("m IS NOT NULL").select(*key, "period_d", "m.power", "m.depth", "m.depth_snr", "m.duration_min", "m.t0", "m.n_in")


def _spectrum_in_tasks(q: DataFrame, ok: DataFrame, cfg: SearchConfig, task_rows: int) -> DataFrame:
    w, boxes = cfg.widths()
    ok = cut_lineage(ok)  # a row per curve: counted here, joined below
    rows = ok.agg(F.sum(F.col("n_all") * F.col("n_grid"))).first()[0] or 0
    packed = q.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("time", "yq"))).alias("c")).join(ok, CURVE)
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(task_rows) / F.col("n_all")))
    chunks = packed.select(*CURVE, "t_min", "n_all", "s_all", "p_max_d", "n_grid", F.col("c.time").alias("ts"), F.col("c.yq").alias("ys"), step.alias("step"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_grid") - 1, step)).alias("lo"))
    # folding is heavy for its bytes: an explicit partition count keeps adaptive coalescing from merging tasks
    chunks = chunks.repartition(1 + max(task_count(q.sparkSession), -(-rows // task_rows)), *CURVE, "lo")
    f_max = 1.0 / cfg.p_min_d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, ys = batch.column("ts"), batch.column("ys")
            for i, row in enumerate(batch.drop_columns(["ts", "ys"]).to_pylist()):
                t, y = ts[i].values.to_numpy() - row["t_min"], ys[i].values.to_numpy()
                f_min, last = 1.0 / row["p_max_d"], min(row["n_grid"], row["lo"] + row["step"])
                sub = max(1, BIN_ELEMENTS // max(1, t.size))
                parts = []
                for a in range(row["lo"], last, sub):
                    idx = np.arange(a, min(last, a + sub), dtype=np.int64)
                    periods = 1.0 / (f_max - idx * ((f_max - f_min) / float(row["n_grid"] - 1)))
                    power, n_in, o = _fold_bins(t, y, periods, w, boxes, row["n_all"], row["s_all"])
                    ok = power > 0
                    parts.append((idx[ok], periods[ok], power[ok], o["depth"][ok], o["snr"][ok], o["dur"][ok], row["t_min"] + o["t0"][ok], n_in[ok]))
                cols = [np.concatenate(x) for x in zip(*parts)]
                curve = [pa.repeat(pa.scalar(row["tic"], pa.int64()), cols[0].size), pa.repeat(pa.scalar(row["aperture"], pa.string()), cols[0].size)]
                yield pa.RecordBatch.from_arrays([*curve, *map(pa.array, cols)], names=[c.split()[0] for c in SPECTRUM.split(", ")])

    return chunks.mapInArrow(run, SPECTRUM)


def _phase_bins(t: np.ndarray, periods: np.ndarray, w: float) -> np.ndarray:
    """``floor(fmod(t, period) / w)``; the slow exact remainder is taken for the few times alone that lie next to an edge of a bin or cycle."""
    x = (t + 1e-11) * (1.0 / periods)[:, None]  # a time right before the end of a cycle counts as next to its start
    x -= np.floor(x)
    x *= (periods / w)[:, None]
    bins = x.astype(np.int64)
    x -= bins
    close = x < 1e-9
    close |= x > 1 - 1e-9
    close = np.flatnonzero(close)
    bins.ravel()[close] = np.floor(np.fmod(t[close % t.size], periods[close // t.size]) / w)
    return bins


def _fold_bins(t: np.ndarray, y: np.ndarray, periods: np.ndarray, w: float, boxes, n_all: int, s_all: int):
    """``_fold_chunk`` for curves with few bins for their rows: counts and sums of every bin, boxes grown bin by bin.

    Flux is centred and scaled by the number of rows, so that sums stay whole numbers; the root of a box's power is then its sum times a
    factor of its count. Boxes within rounding of the best are judged by the exact power, as ties are: the narrowest box, then the first bin.
    """
    k_max, p = boxes[-1][0], periods.size
    n_bins = np.ceil(periods / w).astype(np.int64)
    b = int(n_bins.max())
    z = y.astype(np.float64) * n_all - s_all
    if b + k_max > 4 * t.size or not np.abs(z).sum() < 2.0 ** 52 or not t.max() / periods.min() < 1000 or n_all > 2 ** 20:
        return _fold_chunk(t, y, periods, w, boxes, n_all, s_all)
    width, row = b + k_max, np.arange(p)
    at = (_phase_bins(t, periods, w) + (row * width)[:, None]).ravel()
    n = np.bincount(at, minlength=p * width).reshape(p, width)
    s = np.bincount(at, np.broadcast_to(z, (p, t.size)).ravel(), p * width).reshape(p, width)
    occupied = n[:, :b] > 0
    # the first bins appear again one cycle later
    turn = row[:, None], n_bins[:, None] + np.arange(k_max - 1)
    first_n, first_s = n[:, :k_max - 1].copy(), s[:, :k_max - 1].copy()
    n[turn] += first_n
    s[turn] += first_s
    share = np.arange(1, n_all)
    factor = np.concatenate([[0.0], 1.0 / np.sqrt(share) / (1.0 - share / n_all), np.zeros(n_all + 1)])
    n_in, s_in, gain, x = np.zeros((p, b), np.int64), np.zeros((p, b)), np.zeros((p, b)), np.empty((p, b))
    for k in range(1, k_max + 1):
        n_in += n[:, k - 1:b + k - 1]
        s_in += s[:, k - 1:b + k - 1]
        if any(k == size for size, _ in boxes):
            factor.take(n_in, out=x, mode="clip")
            x *= s_in
            np.minimum(gain, x, out=gain)
    gain *= occupied
    top = gain.min(axis=1)
    hr, start = np.divmod(np.flatnonzero(gain <= np.where(top < 0, top * (1 - 1e-12), -np.inf)[:, None]), b)
    # counts and sums of the boxes at each best start
    sums = n[hr[:, None], start[:, None] + np.arange(k_max)].cumsum(axis=1), s[hr[:, None], start[:, None] + np.arange(k_max)].cumsum(axis=1)
    ks = np.array([k for k, _ in boxes])
    n_in, s_in = (x[:, ks - 1] for x in sums)
    s_in = (np.rint(s_in).astype(np.int64) + n_in * s_all) // n_all
    n_out = np.where(n_in < n_all, n_all - n_in, 1)
    depth = ((s_all - s_in) / n_out - s_in / n_in) / UNIT
    power = np.where((n_in < n_all) & (depth > 0), 0.5 * n_in * depth * depth, -1.0)
    j = power.argmax(axis=1)  # the narrowest of a start's equals
    top = power[np.arange(j.size), j]
    i = np.lexsort((start, ks[j], -top, hr))
    i = i[np.diff(hr[i], prepend=-1) > 0]
    i = i[top[i] > 0]
    hr, j = hr[i], j[i]
    best_power, best_n = np.full(p, -1.0), np.zeros(p, np.int64)
    out = {c: np.zeros(p) for c in ("depth", "snr", "dur", "t0")}
    best_power[hr], best_n[hr] = power[i, j], n_in[i, j]
    out["depth"][hr] = depth[i, j]
    out["snr"][hr] = depth[i, j] / np.sqrt(1.0 / n_in[i, j] + 1.0 / n_out[i, j])
    out["dur"][hr] = np.array([d for _, d in boxes])[j]
    out["t0"][hr] = (start[i] + ks[j] / 2.0) * w
    return best_power, best_n, out


def _bin_sums(bins: np.ndarray, y: np.ndarray, n_bins: np.ndarray, boxes):
    """Occupied bins of each period (rows, bins) and a function from box width to the rows and sums in the box that starts at each of them,
    by counts and sums of every bin. For curves with few bins for their rows; sums must fit a double's 53 bits."""
    k_max, p = boxes[-1][0], bins.shape[0]
    width = int(n_bins.max()) + k_max + 1
    flat = (bins + np.arange(p, dtype=np.int64)[:, None] * width).ravel()
    n = np.bincount(flat, minlength=p * width).reshape(p, width)
    s = np.bincount(flat, np.broadcast_to(y.astype(np.float64), bins.shape).ravel(), p * width).reshape(p, width).astype(np.int64)
    rows, start = np.nonzero(n)
    # the first bins appear again one cycle later
    turn = np.arange(p)[:, None], n_bins + np.arange(k_max - 1)
    first_n, first_s = n[:, :k_max - 1].copy(), s[:, :k_max - 1].copy()
    n[turn] += first_n
    s[turn] += first_s
    zero = np.zeros((p, 1), np.int64)
    n, s = (np.concatenate([zero, np.cumsum(x, axis=1)], axis=1).ravel() for x in (n, s))
    at = rows * (width + 1) + start
    n0, s0 = n[at], s[at]
    reach = lambda k: np.minimum(start + k, width) - start
    return rows, start, lambda k: (n[at + reach(k)] - n0, s[at + reach(k)] - s0)


def _sorted_sums(bins: np.ndarray, y: np.ndarray, n_bins: np.ndarray, boxes):
    """The same as ``_bin_sums`` by order of bins, for curves of any size and number of bins."""
    order = np.argsort(bins, axis=1, kind="stable")
    bins = np.take_along_axis(bins, order, axis=1)
    ys = y[order]
    k_max = boxes[-1][0]
    p, n = bins.shape
    # rows of the first bins appear again one cycle later
    wrap = np.where(bins < k_max - 1, bins + n_bins, np.int64(1) << 40)
    pos = np.concatenate([bins, wrap], axis=1)
    stride = np.int64(1) << 42
    flat = (pos + np.arange(p, dtype=np.int64)[:, None] * stride).ravel()
    csum = np.concatenate([np.zeros((p, 1), np.int64), np.cumsum(np.concatenate([ys, ys], axis=1), axis=1)], axis=1)
    first = np.ones_like(bins, dtype=bool)
    first[:, 1:] = bins[:, 1:] != bins[:, :-1]
    rows, cols = np.nonzero(first)
    start_bin = bins[rows, cols]
    base = csum[rows, cols]

    def box(k: int):
        ends = np.searchsorted(flat, rows * stride + start_bin + k, side="left") - rows * (2 * n)
        return ends - cols, csum[rows, ends] - base
    return rows, start_bin, box


def _fold_chunk(t: np.ndarray, y: np.ndarray, periods: np.ndarray, w: float, boxes, n_all: int, s_all: int):
    """Best box per period for one curve; rows of the work arrays are periods."""
    bins = np.floor(np.mod(t[None, :], periods[:, None]) / w).astype(np.int64)
    n_bins = np.ceil(periods / w).astype(np.int64)[:, None]
    p = periods.size
    few = n_bins.max() + boxes[-1][0] <= 4 * t.size and np.abs(y).astype(np.float64).sum() < 2.0 ** 52
    rows, start_bin, box = (_bin_sums if few else _sorted_sums)(bins, y, n_bins, boxes)
    # boxes x starts: every start has each box
    in_box = [box(k) for k, _ in boxes]
    n_in, s_in = np.stack([x for x, _ in in_box]), np.stack([x for _, x in in_box])
    valid = n_in < n_all
    n_out = np.where(valid, n_all - n_in, 1)
    depth = ((s_all - s_in) / n_out - s_in / n_in) / UNIT
    power = np.where(valid & (depth > 0), 0.5 * n_in * depth * depth, -1.0)
    # rows ascend and every period has an occupied bin, so each period is one run
    seg = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    top = np.maximum.reduceat(power.max(axis=0), seg)
    # the strongest of each period, of equals the narrowest box, then the first bin
    which, src = np.nonzero(power == np.where(top > 0, top, np.nan)[rows])
    hr, first = np.unique(rows[src], return_index=True)
    which, src = which[first], src[first]
    best_power, best_n = np.full(p, -1.0), np.zeros(p, np.int64)
    out = {k: np.zeros(p) for k in ("depth", "snr", "dur", "t0")}
    best_power[hr], best_n[hr] = top[hr], n_in[which, src]
    out["depth"][hr] = depth[which, src]
    out["snr"][hr] = depth[which, src] / np.sqrt(1.0 / n_in[which, src] + 1.0 / n_out[which, src])
    out["dur"][hr] = np.array([d for _, d in boxes])[which]
    out["t0"][hr] = (start_bin[src] + np.array([k for k, _ in boxes])[which] / 2.0) * w
    return best_power, best_n, out


def spectrum_packed(q: DataFrame, stats: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Per-period maxima in bulk: one packed curve row per chunk of trial periods."""
    packed = q.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("time", "yq"))).alias("c"))
    return fold_packed(packed.join(stats.select(*CURVE, "t_min", "n_all", "s_all", "p_max_d", "baseline_d", "status"), CURVE), cfg)


def fold_packed(packed: DataFrame, cfg: SearchConfig) -> DataFrame:
    """``spectrum_packed`` of ``packed_curves``."""
    w, boxes = cfg.widths()
    f_max, step = 1.0 / cfg.p_min_d, cfg.chunk_periods
    chunks = packed.where("status = 'ok'").select(*CURVE, "t_min", "n_all", "s_all", "p_max_d", grid_size(cfg).cast("int").alias("n"), F.col("c.time").alias("ts"), F.col("c.yq").alias("ys"),
                           F.explode(F.sequence(F.lit(0), grid_size(cfg).cast("int") - 1, F.lit(step))).alias("lo"))
    # folding is heavy for its bytes: an explicit partition count keeps adaptive coalescing from merging tasks
    spark = packed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    chunks = chunks.repartition(tasks, *CURVE, "lo")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for row in pdf.itertuples(index=False):
                t = np.asarray(row.ts, dtype=np.float64) - row.t_min
                y = np.asarray(row.ys, dtype=np.int64)
                n, f_min = row.n, 1.0 / row.p_max_d
                sub = max(1, FOLD_ELEMENTS // max(1, t.size))
                hi = min(n, row.lo + step)
                for a in range(row.lo, hi, sub):
                    idx = np.arange(a, min(hi, a + sub), dtype=np.int64)
                    periods = 1.0 / (f_max - idx * ((f_max - f_min) / float(n - 1)))
                    power, n_in, o = _fold_chunk(t, y, periods, w, boxes, int(row.n_all), int(row.s_all))
                    ok = power > 0
                    n_ok = int(ok.sum())
                    parts.append((np.full(n_ok, row.tic), np.full(n_ok, row.aperture, object), idx[ok], periods[ok], power[ok], o["depth"][ok], o["snr"][ok],
                                  o["dur"][ok], row.t_min + o["t0"][ok], n_in[ok]))
            if parts:
                yield pd.DataFrame({c.split()[0]: np.concatenate(x) for c, x in zip(SPECTRUM.split(", "), zip(*parts))})

    return chunks.mapInPandas(run, SPECTRUM)


def spectrum(q: DataFrame, stats: DataFrame, cfg: SearchConfig, hot: bool = False) -> DataFrame:
    """Bulk plan for curves below the hot limit, binned plan for the rest; same numbers either way."""
    if not hot:
        return spectrum_packed(q, stats, cfg)
    limit = hot_rows(q.sparkSession)
    big = stats.where(F.col("n_all") > limit)
    small = stats.where(F.col("n_all") <= limit)
    return spectrum_packed(q.join(small.select(*CURVE), CURVE, "left_semi"), small, cfg).unionByName(
        spectrum_binned(q.join(big.select(*CURVE), CURVE, "left_semi"), big, cfg))


def with_sde(spec: DataFrame) -> DataFrame:
    """Robust z-score of power per curve (a group is one grid), std where MAD is 0, else 0."""
    w = W.partitionBy(*CURVE)
    d = spec.withColumn("_m", F.median("power").over(w)).withColumn("_d", F.median(F.abs(F.col("power") - F.col("_m"))).over(w))
    d = d.withColumn("_s", F.stddev_pop("power").over(w))
    x = F.col("power") - F.col("_m")
    sde = (F.when(F.col("_d") > 0, x / F.nullif(F.lit(K.MAD_SIGMA) * F.col("_d"), F.lit(0.0)))
           .when(F.col("_s") > 0, x / F.nullif("_s", F.lit(0.0))).otherwise(F.lit(0.0)))
    return d.withColumn("sde", sde).drop("_m", "_d", "_s")


def separated_peaks(period: np.ndarray, sde: np.ndarray, n_peaks: int, mask_fraction: float,
                    edges: Sequence[float] = (), per_bin: int = 0) -> list[int]:
    """Indices of the strongest trial periods of which none lies in the neighbourhood of a stronger one or of its harmonics.

    One pass in order of strength; a pick closes ranges of the sorted periods. With ``per_bin``, periods outside ``edges`` are
    left out and each range between two edges gives at most so many peaks.
    """
    sde = np.asarray(sde, dtype=float)
    by_period = np.argsort(period, kind="stable")
    ladder, place = period[by_period], np.empty(period.size, dtype=int)
    place[by_period] = np.arange(period.size)
    closed = np.zeros(period.size, dtype=bool)
    bounds = np.array(sorted({float(e) for e in edges}))
    quota = per_bin > 0 and bounds.size >= 2
    taken = np.zeros(bounds.size + 1, dtype=int)
    out: list[int] = []
    for i in np.argsort(-sde, kind="stable"):
        if len(out) == n_peaks:
            break
        if closed[place[i]] or not np.isfinite(sde[i]):
            continue
        if quota:
            cell = int((bounds <= period[i]).sum())
            if cell in (0, bounds.size) or taken[cell] == per_bin:
                continue
            taken[cell] += 1
        out.append(int(i))
        for factor in K.PEAK_MASK_FACTORS:
            centre, reach = period[i] * factor, period[i] * factor * mask_fraction
            closed[np.searchsorted(ladder, centre - reach, "left"):np.searchsorted(ladder, centre + reach, "right")] = True
    return out


def pick_peaks(spec: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Ranked peaks per curve; one array row holds one grid of at most ``n_periods`` trial periods."""
    cols = [c.split()[0] for c in SPECTRUM.split(", ")][2:] + ["sde"]

    @F.pandas_udf("array<int>")
    def picks(period: pd.Series, sde: pd.Series) -> pd.Series:
        return pd.Series([separated_peaks(np.asarray(p), np.asarray(s), cfg.n_peaks, cfg.mask_fraction, cfg.period_bin_edges, cfg.max_peaks_per_bin)
                          for p, s in zip(period, sde)])

    g = spec.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("all"))
    g = g.withColumn("at", picks(F.col("all.period_d"), F.col("all.sde")))
    g = g.select(*CURVE, F.posexplode(F.transform("at", lambda i: F.col("all")[i])).alias("pos", "p"))
    return g.select(*CURVE, *[f"p.{c}" for c in cols], (F.col("pos") + 1).cast("int").alias("peak_rank"))


def pick_peaks_native(spec: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The same walk as a fold over the SDE-sorted array, JVM-side; meant for grids of some hundred periods."""
    cols = [c.split()[0] for c in SPECTRUM.split(", ")][2:]
    item = F.struct((-F.col("sde")).alias("neg_sde"), "period_idx", *[c for c in cols if c != "period_idx"], "sde")
    g = spec.where(robust.finite(F.col("sde"))).groupBy(*CURVE).agg(F.array_sort(F.collect_list(item)).alias("all"))
    frac = F.lit(cfg.mask_fraction)

    def hidden(c, picked):
        near = lambda q, f: F.abs(c["period_d"] - q["period_d"] * f) <= q["period_d"] * f * frac
        return F.exists(picked, lambda q: near(q, 1.0) | near(q, 1.0 / 3.0) | near(q, 0.5) | near(q, 2.0) | near(q, 3.0))

    picked = F.aggregate("all", F.slice("all", 1, 0),
                         lambda acc, c: F.when((F.size(acc) < cfg.n_peaks) & ~hidden(c, acc), F.concat(acc, F.array(c))).otherwise(acc))
    return g.select(*CURVE, F.posexplode(picked).alias("pos", "p")).select(
        *CURVE, *[f"p.{c}" for c in cols], "p.sde", (F.col("pos") + 1).cast("int").alias("peak_rank"))


def complete_status(requested: DataFrame, stats: DataFrame, peaks: DataFrame) -> DataFrame:
    """Every requested (target, aperture) yields a row: failures get rank 0 and empty peak fields."""
    base = requested.select(*CURVE).distinct().join(stats.select(*CURVE, "n_all", "baseline_d", "n_orbits", "status"), CURVE, "left")
    out = base.join(peaks, CURVE, "left")
    status = F.coalesce("status", F.lit("missing_aperture"))
    status = F.when((status == "ok") & F.col("peak_rank").isNull(), "nan_power").otherwise(status)
    return out.withColumns({"peak_rank": F.coalesce("peak_rank", F.lit(0)), "status": status})


def search(cadences: DataFrame, cfg: SearchConfig, hot: bool = False, keep_spectrum: bool = False):
    """Clean, search, score and rank; returns peaks with status rows (and the spectrum on request)."""
    clean = cadence.clean(cadences, cfg.min_cadences, cfg.edge_trim_d, cfg.sigma_clip, hot)
    q = with_integer_flux(clean)
    if hot:
        stats = curve_stats(q, cfg)
        spec = with_sde(spectrum(q, stats, cfg, hot))
    else:
        packed = packed_curves(q, cfg)
        stats, spec = packed.drop("c"), with_sde(fold_packed(packed, cfg))
    rows = complete_status(cadences, stats, pick_peaks(spec, cfg))
    return (rows, spec) if keep_spectrum else rows


def unfinished(pairs: DataFrame, done: DataFrame, shard: int | None = None, n_shards: int = 1) -> DataFrame:
    """Pairs of one shard that have no finished rows yet; lets a stopped search resume."""
    if shard is not None:
        pairs = pairs.where(F.pmod(F.xxhash64("tic"), F.lit(n_shards)) == shard)
    return pairs.join(done.select(*CURVE).distinct(), CURVE, "left_anti")


# --- consolidation ---------------------------------------------------------

def _cells(period: Column, tol: float) -> tuple[Column, int]:
    """Cell of log2(P) modulo one octave; linkable periods are in equal or adjacent cells."""
    n = int(1.0 / np.log2(1.0 + 2 * tol))
    return F.floor(F.pmod(F.log2(period), F.lit(1.0)) * n).cast("int"), n


def period_components(peaks: DataFrame, keys: Sequence[str], tol: float = K.CLUSTER_PERIOD_TOL) -> DataFrame:
    """Attach ``component``: runs of occupied period cells (cyclic over an octave).

    Clusters link periods at ratios 1, 1/2 and 2 only, so rows of different components never meet and
    each component can be clustered alone. At most a few hundred cells exist per key.
    """
    keys = list(keys)
    cell, n = _cells(F.col("period_d"), tol)
    d = peaks.withColumn("_cell", cell)
    occ = d.select(*keys, "_cell").distinct()
    w = W.partitionBy(*keys).orderBy("_cell")
    occ = occ.withColumn("_new", F.coalesce((F.col("_cell") - F.lag("_cell").over(w)) > 1, F.lit(True)).cast("int"))
    occ = occ.withColumn("component", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    every = W.partitionBy(*keys)
    # the first and last cells touch across the octave boundary
    joins_ends = (F.min("_cell").over(every) == 0) & (F.max("_cell").over(every) == n - 1)
    last = F.max("component").over(every)
    occ = occ.withColumn("component", F.when(joins_ends & (F.col("component") == last), F.lit(1)).otherwise(F.col("component")))
    return d.join(occ.select(*keys, "_cell", "component"), [*keys, "_cell"]).drop("_cell")


def greedy_groups(period: np.ndarray, t0: np.ndarray, tol: float, epoch_min: float) -> list[int]:
    """Cluster number per row of a list sorted by strength: the first free row seeds, later ones join
    when period (at 1, 1/2 or 2 times) and epoch agree with the seed."""
    label = np.full(period.size, -1, dtype=np.int64)
    k = 0
    while (label < 0).any():
        i = int((label < 0).argmax())
        seed = period[i]
        rel = np.min([np.abs(period - seed * f) / (seed * f) for f in (1.0, 0.5, 2.0)], axis=0)
        off = np.abs(np.mod(t0 - t0[i] + seed / 2, seed) - seed / 2) * K.MIN_PER_DAY
        join = (label < 0) & (rel < tol) & (off <= epoch_min)
        join[i] = True
        label[join] = k
        k += 1
    return label.tolist()


def consolidate(peaks: DataFrame, apertures: Sequence[str], sde_min: float = K.CLUSTER_SDE_MIN,
                tol: float = K.CLUSTER_PERIOD_TOL, epoch_min: float = K.CLUSTER_EPOCH_TOL_MIN) -> DataFrame:
    """One row per cluster of peaks that agree across apertures, with per-aperture best values.

    Seeding is sequential, so a (target, sector, period component) is clustered inside one task.
    """
    ok = peaks.where((F.col("status") == "ok") & robust.finite(F.col("period_d")) & (F.col("sde") >= sde_min) & (F.col("tic") >= 0))
    d = period_components(ok, ["tic", "sector"], tol)
    rep = ["cam", "ccd", "tmag", "period_d", "t0_bjd", "duration_min", "depth", "depth_snr", "sde", "aperture", "peak_rank", "baseline_d", "bls_run_id"]

    @F.pandas_udf("array<int>")
    def groups(period: pd.Series, t0: pd.Series) -> pd.Series:
        return pd.Series([greedy_groups(np.asarray(p), np.asarray(t), tol, epoch_min) for p, t in zip(period, t0)])

    # strongest first; ties by aperture, rank and ephemeris
    member = F.struct((-F.col("sde")).alias("neg_sde"), "aperture", "peak_rank", "period_d", "t0_bjd",
                      *[c for c in rep if c not in ("aperture", "peak_rank", "period_d", "t0_bjd")], "n_cad_kept")
    packed = d.groupBy("tic", "sector", "component").agg(F.array_sort(F.collect_list(member)).alias("m"))
    alone = packed.where(F.size("m") == 1).withColumn("g", F.array(F.lit(0)))
    several = packed.where(F.size("m") > 1).withColumn("g", groups(F.col("m.period_d"), F.col("m.t0_bjd")))
    c = alone.unionByName(several).select("tic", "sector", "component", F.explode(F.arrays_zip("g", "m")).alias("z"))
    c = c.select("tic", "sector", "component", F.col("z.g").alias("cluster"), "z.m.*").drop("neg_sde")
    best = F.struct("sde", (-F.col("peak_rank")).alias("nr"), "aperture", "period_d", "t0_bjd")
    per_ap = []
    for a in apertures:
        here = F.when(F.col("aperture") == a, F.struct("sde", "peak_rank"))
        top = F.max_by(here, F.when(F.col("aperture") == a, best))
        per_ap += [top["sde"].alias(f"sde_{a}"), F.coalesce(top["peak_rank"], F.lit(0)).alias(f"rank_{a}")]
    g = c.groupBy("tic", "sector", "component", "cluster").agg(
        F.max_by(F.struct(*rep), best).alias("r"), F.array_sort(F.collect_set("aperture")).alias("aps"),
        *per_ap, F.max("n_cad_kept").alias("n_cad_kept_max"), F.count(F.lit(1)).alias("n_members"))
    return g.select("tic", "sector", "r.cam", "r.ccd", "r.tmag", "r.period_d", "r.t0_bjd", "r.duration_min", "r.depth", "r.depth_snr",
                    F.col("r.sde").alias("sde_max"), F.col("r.aperture").alias("rep_aperture"), F.col("r.peak_rank").alias("rep_peak_rank"),
                    F.size("aps").alias("n_apertures_agree"), F.array_join("aps", ",").alias("apertures_agree"),
                    *[x for a in apertures for x in (f"sde_{a}", f"rank_{a}")], "n_cad_kept_max", "n_members", "r.baseline_d", "r.bls_run_id")


def refine(q: DataFrame, stats: DataFrame, centres: DataFrame, half_width: float, n_periods: int, cfg: SearchConfig, min_snr: float = 0.0) -> DataFrame:
    """Best box on a narrow linear grid around each curve's given period, kept when its S/N reaches ``min_snr``.

    ``centres`` has one period per curve; the fold kernel is the bulk search's.
    """
    packed = q.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("time", "yq"))).alias("c"))
    return refine_packed(packed.join(stats.select(*CURVE, "t_min", "n_all", "s_all"), CURVE), centres, half_width, n_periods, cfg, min_snr)


def refine_packed(packed: DataFrame, centres: DataFrame, half_width: float, n_periods: int, cfg: SearchConfig, min_snr: float = 0.0) -> DataFrame:
    """``refine`` of ``packed_curves``; tasks are as many as cores at least, since folding is heavy for its bytes."""
    w, boxes = cfg.widths()
    rows = packed.join(centres.select(*CURVE, F.col("period_d").alias("p0")), CURVE)
    rows = rows.select(*CURVE, "t_min", "n_all", "s_all", "p0", F.col("c.time").alias("ts"), F.col("c.yq").alias("ys"))
    spark = packed.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(*CURVE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                t, y = np.asarray(row.ts, dtype=np.float64) - row.t_min, np.asarray(row.ys, dtype=np.int64)
                p = row.p0 * np.linspace(1 - half_width, 1 + half_width, n_periods)
                sub, best = max(1, FOLD_ELEMENTS // max(1, t.size)), None
                for a in range(0, n_periods, sub):
                    power, n_in, o = _fold_chunk(t, y, p[a:a + sub], w, boxes, int(row.n_all), int(row.s_all))
                    i = int(power.argmax())
                    if power[i] > 0 and (best is None or power[i] > best[4]):
                        best = (row.tic, row.aperture, a + i, float(p[a + i]), float(power[i]), float(o["depth"][i]), float(o["snr"][i]), float(o["dur"][i]), row.t_min + float(o["t0"][i]), int(n_in[i]))
                if best is not None and best[6] >= min_snr:
                    out.append(best)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPECTRUM.split(", ")])

    return rows.mapInPandas(run, SPECTRUM)


def parameter_sweep(cadences: DataFrame, configs: dict[str, SearchConfig], hot: bool = False) -> DataFrame:
    """Peaks of several search settings in one table with a ``sweep`` column."""
    out = None
    for name, cfg in configs.items():
        one = search(cadences, cfg, hot).withColumn("sweep", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def truth_diagnostics(clean: DataFrame, truth: DataFrame, keys: Sequence[str], hot: bool = False, value: str = "y") -> DataFrame:
    """Rows inside the true window and their depth against the level outside max(5 d, d + 20 min)."""
    keys = list(keys)
    d = clean.join(truth.select("tic", "injection_id", "truth_period_d", "truth_t0", "truth_duration_min"), "tic")
    m = F.abs(E.phase_minutes("time", "truth_period_d", "truth_t0"))
    dur = F.col("truth_duration_min")
    d = d.withColumns({"_i": F.when(m <= dur / 2, F.col(value)), "_o": F.when(m > F.greatest(5 * dur, dur + 20), F.col(value))})
    g = d.groupBy(*keys).agg(F.count("_i").alias("n_in"), F.count("_o").alias("n_out"))
    g = g.join(robust.grouped_quantiles(d, keys, F.col("_i"), {"_mi": 0.5}, hot), keys, "left")
    g = g.join(robust.median_mad(d, keys, F.col("_o"), hot, "_mo", "_do"), keys, "left")
    depth = 1 - F.col("_mi") / F.nullif("_mo", F.lit(0.0))
    sigma = F.lit(K.MAD_SIGMA) * F.col("_do") / F.nullif("_mo", F.lit(0.0))
    return g.select(*keys, "n_in", "n_out", depth.alias("depth"), F.when(sigma > 0, depth / F.nullif(sigma, F.lit(0.0)) * F.sqrt("n_in")).alias("snr"))
