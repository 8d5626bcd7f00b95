"""Order-dependent steps along a curve: previous row, running sums, neighbours, framed medians.

With ``hot=False`` each step is one window over the curve. With ``hot=True`` the curve is cut
into time chunks; windows run inside a chunk, and one summary row per chunk carries the
state across the cuts, so no task ever sorts a whole hot curve.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.operators.ordering import with_global_row_number

#: Time chunk of the hot plan, in days (about a thousand 20-second cadences).
CHUNK_D = 0.25


def _chunked(df: DataFrame, time: str, chunk_d: float) -> DataFrame:
    """Chunk numbers in the order of the times: missing times first and NaN last, as in a sort."""
    t = F.col(time).cast("double")
    low, high = F.lit(-(1 << 62)), F.lit(1 << 62)
    return df.withColumn("_chunk", F.when(t.isNull(), low).when(F.isnan(t), high).otherwise(F.floor(t / chunk_d)))


def _attach(d: DataFrame, per_chunk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One summary row per chunk beside its rows; missing keys equal each other."""
    on = [*keys, "_chunk"]
    s = per_chunk.withColumnsRenamed({k: f"_k_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on]
    return d.join(s, reduce(lambda a, b: a & b, same)).drop(*[f"_k_{k}" for k in on])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, Column],
                  hot: bool = False, chunk_d: float = CHUNK_D) -> DataFrame:
    """Attach values of the preceding row, ordered by ``order`` (time first, then tie-breaks)."""
    keys = list(keys)
    payload = F.struct(*[c.alias(n) for n, c in cols.items()])
    if not hot:
        prev = F.lag(payload).over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_p", prev).withColumns({n: F.col(f"_p.{n}") for n in cols}).drop("_p")
    d = _chunked(df, order[0], chunk_d).withColumn("_pay", payload)
    tails = d.groupBy(*keys, "_chunk").agg(F.max_by("_pay", F.struct(*order)).alias("_tail"))
    tails = tails.withColumn("_carry", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_chunk"))).drop("_tail")
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    d = d.withColumns({"_p": F.lag("_pay").over(w), "_rn": F.row_number().over(w)})
    d = _attach(d, tails, keys)
    d = d.withColumn("_p", F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_p")))
    return d.withColumns({n: F.col(f"_p.{n}") for n in cols}).drop("_p", "_rn", "_carry", "_chunk", "_pay")


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                     hot: bool = False, chunk_d: float = CHUNK_D) -> DataFrame:
    """Attach the inclusive running sum of ``value`` along ``order``."""
    keys = list(keys)
    rows = lambda *p: W.partitionBy(*p).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if not hot:
        return df.withColumn(out, F.sum(value).over(rows(*keys)))
    d = _chunked(df, order[0], chunk_d).withColumn("_val", value)
    sums = d.groupBy(*keys, "_chunk").agg(F.sum("_val").alias("_s"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    d = _attach(d, sums, keys)
    return d.withColumn(out, F.col("_off") + F.sum("_val").over(rows(*keys, "_chunk"))).drop("_off", "_chunk", "_val")


def with_row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_idx",
                   hot: bool = False, chunk_d: float = CHUNK_D) -> DataFrame:
    """0-based position along ``order``."""
    return with_running_sum(df, keys, order, F.lit(1).cast("bigint"), "_pos1", hot, chunk_d) \
        .withColumn(out, F.col("_pos1") - 1).drop("_pos1")


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                    before: str, after: str, hot: bool = False, chunk_d: float = CHUNK_D) -> DataFrame:
    """Attach the nearest non-null ``value`` at or before and at or after each row (linear as-of join)."""
    keys = list(keys)
    back = lambda *p: W.partitionBy(*p).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    fwd = lambda *p: W.partitionBy(*p).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    if not hot:
        return df.withColumn("_nv", value).withColumns({
            before: F.last("_nv", ignorenulls=True).over(back(*keys)),
            after: F.first("_nv", ignorenulls=True).over(fwd(*keys))}).drop("_nv")
    d = _chunked(df, order[0], chunk_d).withColumn("_nv", value)
    has = F.col("_nv").isNotNull()
    ends = d.groupBy(*keys, "_chunk").agg(
        F.max_by("_nv", F.when(has, F.struct(*order))).alias("_l"), F.min_by("_nv", F.when(has, F.struct(*order))).alias("_f"))
    by = W.partitionBy(*keys).orderBy("_chunk")
    ends = ends.select(*keys, "_chunk",
                       F.last("_l", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("_cb"),
                       F.first("_f", ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing)).alias("_ca"))
    d = _attach(d, ends, keys)
    return d.withColumns({
        before: F.coalesce(F.last("_nv", ignorenulls=True).over(back(*keys, "_chunk")), F.col("_cb")),
        after: F.coalesce(F.first("_nv", ignorenulls=True).over(fwd(*keys, "_chunk")), F.col("_ca")),
    }).drop("_nv", "_cb", "_ca", "_chunk")


def with_gap_segments(df: DataFrame, keys: Sequence[str], time: str, tie: str, gap_d: float,
                      out: str = "segment", hot: bool = False, chunk_d: float = CHUNK_D) -> DataFrame:
    """Number the stretches separated by gaps longer than ``gap_d``, from 0."""
    d = with_previous(df, keys, [time, tie], {"_pt": F.col(time)}, hot, chunk_d)
    cut = F.coalesce((F.col(time) - F.col("_pt")) > gap_d, F.lit(False)).cast("bigint")
    return with_running_sum(d.withColumn("_cut", cut), keys, [time, tie], F.col("_cut"), out, hot, chunk_d).drop("_pt", "_cut")


def _median_of(sorted_arr: Column) -> Column:
    n = F.size(sorted_arr)
    mid = F.floor((n + 1) / 2).cast("int")
    mid2 = F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.try_element_at(sorted_arr, mid) + F.try_element_at(sorted_arr, mid2)) / 2)


def with_running_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                        half_width: int, hot: bool = False, chunk_d: float = CHUNK_D, block: int = 4096) -> DataFrame:
    """Centred median of +-``half_width`` rows, truncated at the ends, missing values skipped.

    The hot plan copies ``half_width`` edge rows into the neighbouring blocks and runs the frame per block.
    """
    keys = list(keys)
    d = df.withColumn("_mv", value)

    def framed(part):
        w = W.partitionBy(*part).orderBy(*order).rowsBetween(-half_width, half_width)
        return _median_of(F.array_sort(F.collect_list("_mv").over(w)))

    if not hot:
        return d.withColumn(out, framed(keys)).drop("_mv")
    d = with_row_index(d, keys, order, "_ri", hot, chunk_d).withColumn("_home", F.floor(F.col("_ri") / block))
    inside = F.col("_ri") - F.col("_home") * block
    copies = F.filter(F.array(
        F.col("_home"), F.when(inside < half_width, F.col("_home") - 1), F.when(inside >= block - half_width, F.col("_home") + 1)),
        lambda b: b.isNotNull() & (b >= 0))
    d = d.withColumn("_block", F.explode(copies)).withColumn(out, framed([*keys, "_block"]))
    return d.where(F.col("_block") == F.col("_home")).drop("_mv", "_ri", "_home", "_block")


def with_adaptive_median(df: DataFrame, x: str, y: str, tie: str, low: tuple[float, int], high: tuple[float, int], out: str = "smooth",
                         limit: int | None = None, block: int = 4096) -> DataFrame:
    """Running median of ``y`` over all rows in the order of (``x``, ``tie``), with a frame that changes along ``x``.

    The frame's size is interpolated between two (x, size) points and held beyond them; it reaches half of it, at least one row,
    to both sides and is cut at the ends. Rows without finite ``x`` or ``y`` are left out. Positions come from a distributed
    global order; blocks of positions take along the rows of the widest frame at their edges, so no task holds the whole order.
    """
    (x0, n0), (x1, n1) = low, high
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    v = F.col(x).cast("double")
    size = F.when(v <= x0, float(n0)).when(v >= x1, float(n1)).otherwise(n0 + (v - x0) * ((n1 - n0) / (x1 - x0)))
    half = F.greatest(F.floor(F.greatest(F.rint(size), F.lit(1.0)) / 2), F.lit(1)).cast("int")
    widest = max(1, max(round(n0), round(n1)) // 2)
    block = max(block, 2 * widest)
    d = with_global_row_number(df.where(finite(x) & finite(y)), [F.col(x), F.col(tie)], "_p", limit).withColumns({"_half": half, "_home": F.floor((F.col("_p") - 1) / block)})
    inside = (F.col("_p") - 1) - F.col("_home") * block
    copies = F.filter(F.array(F.col("_home"), F.when(inside < widest, F.col("_home") - 1), F.when(inside >= block - widest, F.col("_home") + 1)),
                      lambda b: b.isNotNull() & (b >= 0))
    d = d.withColumn("_block", F.explode(copies))
    order = W.partitionBy("_block").orderBy("_p")
    d = d.withColumns({"_all": F.collect_list(F.col(y).cast("double")).over(order.rowsBetween(-widest, widest)), "_at": F.least(F.row_number().over(order), F.lit(widest + 1))})
    first = F.greatest(F.col("_at") - F.col("_half"), F.lit(1))
    frame = F.slice("_all", first, F.col("_at") + F.col("_half") - first + 1)
    return d.where(F.col("_block") == F.col("_home")).withColumn(out, _median_of(F.array_sort(frame))).drop("_p", "_half", "_home", "_block", "_all", "_at")
