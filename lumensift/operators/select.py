"""Deterministic selection: top-k per target, stratified and balanced picks, quota buckets, blinding.

Random picks are hash orders. Every pick ends in ``limit`` or a per-stratum rank filter, which Spark cuts
map-side, so a stratum holding a third of the table sends only its first n rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.functions import exprs as E
from lumensift.functions.hashing import digest
from lumensift.operators.ordering import ONE_WINDOW_ROWS, cut_lineage, rank_bins, with_global_row_number
from lumensift.operators.vet import desc_last, first_by
from lumensift.operators.skew import with_row


def per_stratum(df: DataFrame, strata: Sequence[str], n: int | Column, order: Sequence[Column], out: str = "stratum_rank") -> DataFrame:
    """First ``n`` rows per stratum by ``order``."""
    w = W.partitionBy(*strata).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def one_per_target(df: DataFrame, score: str, tie: Sequence[Column], target: str = "tic") -> DataFrame:
    return first_by(df, [target], desc_last(score), *tie)


def exclude(df: DataFrame, used: DataFrame | None, key: str = "tic") -> DataFrame:
    return df if used is None else df.join(used.select(key).distinct(), key, "left_anti")


def top_unique(df: DataFrame, score: str, n: int, used: DataFrame | None = None, target: str = "tic") -> DataFrame:
    """Best row per unused target; score desc, strength desc, rank asc, target asc; first n with a rank."""
    best = one_per_target(exclude(df, used, target), score, [desc_last("sde_max"), F.col("rep_peak_rank"), F.col("review_id")], target)
    top = best.orderBy(F.desc_nulls_last(score), F.desc_nulls_last("sde_max"), "rep_peak_rank", target).limit(n)
    w = W.orderBy(F.desc_nulls_last(score), F.desc_nulls_last("sde_max"), "rep_peak_rank", target)  # at most n rows
    return top.withColumn("selection_rank", F.row_number().over(w))


def round_robin(df: DataFrame, strata: Sequence[str], n: int, seed: int, key: str) -> DataFrame:
    """Rounds over strata in hash order until n rows: every stratum gives one row before any gives two."""
    d = df.withColumn("_h", digest(F.col(key), seed))
    d = per_stratum(d, strata, n, [F.col("_h"), F.col(key)], "_round")
    return d.orderBy("_round", "_h", key).limit(n).drop("_h", "_round")


def stratified_controls(df: DataFrame, n: int, seed: int, used: DataFrame | None = None, columns: Sequence[str] = ("tmag", "period_d", "sde_max"),
                        limit: int | None = None) -> DataFrame:
    """Best row per unused target, strata from rank quartiles of several columns, then rounds by hash."""
    best = first_by(exclude(df, used), ["tic"], F.col("rep_peak_rank"), desc_last("sde_max"), F.col("review_id"))
    for c in columns:
        best = rank_bins(best, [F.col(c), F.col("tic")], 4, f"_q_{c}", limit)
    strata = [f"_q_{c}" for c in columns]
    return round_robin(best, strata, n, seed, "tic").drop(*strata)


def stratified_sample(df: DataFrame, by: Column, bins: int, n: int, seed: int, key: str, limit: int | None = None) -> DataFrame:
    """Equal-rank bins, near-equal allocation, topped up in hash order when a bin is short."""
    d = rank_bins(df, [by, F.col(key)], bins, "sample_bin", limit)
    d = d.withColumn("_h", digest(F.col(key), seed))
    d = per_stratum(d, ["sample_bin"], n, [F.col("_h"), F.col(key)], "_r")
    base, extra = divmod(n, bins)
    quota = F.lit(base) + F.when(F.col("sample_bin") < extra, 1).otherwise(0)
    return d.withColumn("_over", (F.col("_r") > quota).cast("int")).orderBy("_over", "_h", key).limit(n).drop("_h", "_r", "_over")


def capped_per_class(df: DataFrame, klass: str, keep_all: str, cap: int, seed: int, key: str) -> DataFrame:
    """All rows of one class, at most ``cap`` hash-ordered rows of each other class."""
    rest = per_stratum(df.where(F.col(klass) != keep_all), [klass], cap, [digest(F.col(key), seed), F.col(key)], "_r").drop("_r")
    return df.where(F.col(klass) == keep_all).unionByName(rest)


def balanced_cells(df: DataFrame, cells: Sequence[str], n: int, seed: int, key: str) -> DataFrame:
    """ceil(n / cells) rows per cell, trimmed or topped up to n in hash order."""
    n_cells = df.select(*cells).distinct().count()
    share = -(-n // max(1, n_cells))
    d = df.withColumn("_h", digest(F.col(key), seed))
    d = per_stratum(d, cells, n, [F.col("_h"), F.col(key)], "_r")
    return d.withColumn("_over", (F.col("_r") > share).cast("int")).orderBy("_over", F.when(F.col("_over") == 0, F.col("_r")).otherwise(0), "_h", key) \
        .limit(n).drop("_h", "_r", "_over")


def selection_scores(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Six bucket scores from class probabilities, strength and the percentile of the duration fraction."""
    d = df.withColumn("_df", F.col("duration_min") / (F.col("period_d") * 1440.0))
    # average rank of ties: both ends of a value's run in the global order
    pos = with_global_row_number(d.select("_df", "review_id"), [F.col("_df"), F.col("review_id")], "_p", limit)
    pct = pos.groupBy("_df").agg(((F.min("_p") + F.max("_p")) / 2 / F.lit(float(df.count()))).alias("_pct"))
    d = d.join(pct, "_df", "left")
    preserve = F.col("p_planet") + F.col("p_eb")
    ps = [F.col(c) for c in ("p_planet", "p_eb", "p_variable", "p_other")]
    entropy = -sum((p * F.log(F.greatest(p, F.lit(1e-12))) for p in ps[1:]), ps[0] * F.log(F.greatest(ps[0], F.lit(1e-12)))) / F.log(F.lit(4.0))
    long_weak = F.when((F.col("period_d") >= 1.0) & (F.col("sde_max") <= 40.0), 1.0).otherwise(0.0)
    return d.withColumns({
        "score_planet": 0.55 * F.col("p_planet") + 0.35 * preserve + 0.10 * long_weak, "score_eb": F.col("p_eb"), "score_variable": F.col("p_variable"),
        "score_broad": preserve * F.coalesce("_pct", F.lit(0.0)) * (1.0 - 0.5 * F.col("p_eb")) * (1.0 - 0.5 * F.col("p_variable")),
        "score_disagreement": 0.45 * entropy, "score_control": F.col("p_other") + (1.0 - preserve)}).drop("_df", "_pct")


@dataclass(frozen=True)
class Bucket:
    """One quota: rows passing ``where``, best ``score`` first, or hash order when ``score`` is None."""

    name: str
    n: int
    where: str = "true"
    score: str | None = None


def quota_buckets(df: DataFrame, buckets: Sequence[Bucket], seed: int, key: str = "review_id", target: str = "tic",
                  excluded: DataFrame | None = None) -> DataFrame:
    """Buckets in order, each skipping targets taken before; short buckets leave room for a final fill.

    A bucket returns at most its quota, so each pick is checkpointed (tiny) and the next bucket anti-joins it;
    the candidate table is scanned once per bucket and never sorted as a whole.
    """
    picked: DataFrame | None = None
    todo = [*buckets, Bucket("fill", sum(b.n for b in buckets))]
    want = sum(b.n for b in buckets)
    have = 0
    for b in todo:
        n = b.n if b.name != "fill" else want - have
        if n <= 0:
            continue
        pool = exclude(exclude(df.where(b.where), excluded, target), picked, target)
        h = digest(F.col(key), seed)
        order = [desc_last(b.score), h] if b.score else [h]
        best = first_by(pool, [target], *order, F.col(key))
        rank = [F.desc_nulls_last(b.score)] if b.score else []
        got = cut_lineage(best.orderBy(*rank, h, target).limit(n).withColumn("bucket", F.lit(b.name)))
        have += got.count()
        picked = got if picked is None else picked.unionByName(got)
    return picked


def blinded(df: DataFrame, seed: int, key: str, hidden: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Public rows in hash order without the hidden columns, and the hidden manifest; both share ``display``."""
    d = with_global_row_number(df, [digest(F.col(key), seed), F.col(key)], "_p").withColumn("display", F.col("_p") - 1).drop("_p")
    return d.drop(*hidden), d.select("display", key, *[h for h in hidden if h != key])


def overlap_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The double-review subset: first n by a second hash."""
    return df.orderBy(digest(F.col(key), seed), key).limit(n)


def verify_batch(queue: DataFrame, hidden: DataFrame, quotas: dict[str, int], key: str, secret: Sequence[str]) -> DataFrame:
    """One row per rule with a pass flag: size, unique targets, quotas, key match, nothing exposed."""
    q = queue.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tic").alias("tics"))
    h = hidden.agg(F.count(F.lit(1)).alias("m"), *[F.count_if(F.col("bucket") == b).alias(f"b_{b}") for b in quotas])
    unmatched = queue.select(key).exceptAll(hidden.select(key)).agg(F.count(F.lit(1)).alias("x"))
    d = q.transform(with_row, h).transform(with_row, unmatched)
    exposed = [c for c in queue.columns if c in secret]
    rules = [("size", F.col("n") == F.col("m")), ("unique_targets", F.col("n") == F.col("tics")), ("keys_match", F.col("x") == 0),
             ("nothing_exposed", F.lit(not exposed)), *[(f"quota_{b}", F.col(f"b_{b}") == n) for b, n in quotas.items()]]
    return d.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("passed")) for r, c in rules])).alias("r")).select("r.*")


def priority_with_harmonics(df: DataFrame, n: int, score: str = "p_mean", floor: float = 0.8, tol: float = 0.02) -> DataFrame:
    """Best row per target; a second one only with a high score and a period harmonic to the first.

    Two struct minima per target replace the greedy walk: the first row by order, then the first later row that
    may accompany it.
    """
    order = [desc_last(score), desc_last("p_std"), desc_last("sde_max"), F.col("review_id")]
    first = first_by(df, ["tic"], *order)
    lead = first.select("tic", F.col("review_id").alias("_lead"), F.col("period_d").alias("_lp"))
    rest = df.join(lead, "tic").where((F.col("review_id") != F.col("_lead")) & (F.col(score) >= floor) & E.is_harmonic("period_d", "_lp", tol))
    second = first_by(rest.drop("_lead", "_lp"), ["tic"], *order)
    both = first.withColumn("policy", F.lit("top_per_tic")).unionByName(second.withColumn("policy", F.lit("harmonic_secondary_exception")))
    top = both.orderBy(F.desc_nulls_last(score), F.desc_nulls_last("p_std"), F.desc_nulls_last("sde_max"), "review_id").limit(n)
    w = W.orderBy(F.desc_nulls_last(score), F.desc_nulls_last("p_std"), F.desc_nulls_last("sde_max"), "review_id")  # at most n rows
    return top.withColumn("priority_rank", F.row_number().over(w))


def pool_with_exclusions(primary: DataFrame, fallback: DataFrame, prior: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Primary before fallback, first per id, without prior ids or prior targets."""
    u = primary.withColumn("_src", F.lit(0)).unionByName(fallback.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    first = first_by(u, [id_col], F.col("_src"), F.col("tic"))
    out = first.join(prior.select(id_col).distinct(), id_col, "left_anti")
    return exclude(out, prior).withColumn("source_pool", F.when(F.col("_src") == 0, "primary").otherwise("fallback")).drop("_src")


def allocation(available: dict[str, int], n: int, rare: Sequence[str], min_each: int, rare_cap: int) -> dict[str, int]:
    """Rows per stratum: rare strata first up to a cap, a minimum for the rest, then shares of what is left."""
    got = dict.fromkeys(sorted(available), 0)
    left = n
    order = [s for s in rare if s in got] + [s for s in got if s not in set(rare)]
    for s in order:
        take = min(available[s], rare_cap if s in rare else min_each, left)
        got[s], left = take, left - take
    while left > 0:
        room = {s: available[s] - got[s] for s in got if available[s] > got[s]}
        if not room:
            break
        total = sum(room.values())
        for s, r in room.items():
            take = min(max(1, round(left * r / total)), r, left)
            got[s], left = got[s] + take, left - take
    return got


def allocated_sample(df: DataFrame, stratum: str, n: int, rare: Sequence[str], min_each: int, rare_cap: int, seed: int, key: str) -> DataFrame:
    """Stratum sizes are aggregated (a handful of rows), allocated, and picked in hash order."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    plan = allocation(sizes, n, rare, min_each, rare_cap)
    quota = F.lit(0)
    for s, k in plan.items():
        quota = F.when(F.col(stratum) == s, k).otherwise(quota)
    top = per_stratum(df, [stratum], max(plan.values(), default=0), [digest(F.col(key), seed), F.col(key)], "_r")
    return top.where(F.col("_r") <= quota).drop("_r")


def coverage_deficits(df: DataFrame, labelled: DataFrame, columns: Sequence[str], target: int) -> DataFrame:
    """(column, value, labelled count, deficit) from one unpivot on each side."""
    long = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coverage_column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("v.*").where("value <> ''")
    have = long(labelled).groupBy("coverage_column", "value").agg(F.count(F.lit(1)).alias("labelled_n"))
    every = long(df).distinct()
    n = F.coalesce("labelled_n", F.lit(0))
    return every.join(have, ["coverage_column", "value"], "left").select("coverage_column", "value", n.alias("labelled_n"), F.greatest(F.lit(0), F.lit(target) - n).alias("deficit"))


def next_rows(df: DataFrame, labelled: DataFrame, columns: Sequence[str], target: int, n: int, key: str = "review_id") -> DataFrame:
    """Unlabelled rows by summed deficit of their values, with reasons; then strength and brightness."""
    deficits = coverage_deficits(df, labelled, columns, target).where("deficit > 0")
    d = df.join(labelled.select(key).distinct(), key, "left_anti")
    score, reasons = F.lit(0), []
    for c in columns:
        one = deficits.where(F.col("coverage_column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("deficit").alias(f"_d_{c}"))
        d = d.join(one, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
        score = score + F.coalesce(F.col(f"_d_{c}"), F.lit(0))
        reasons.append(F.when(F.col(f"_d_{c}").isNotNull(), F.concat(F.lit(f"{c}:"), F.col(f"_v_{c}"), F.lit(":"), F.col(f"_d_{c}").cast("string"))))
    d = d.withColumns({"selection_score": score, "selection_reason": F.concat_ws(";", *reasons)})
    return d.drop(*[f"_{p}_{c}" for p in "vd" for c in columns]).orderBy(F.desc("selection_score"), F.desc_nulls_last("sde_max"), F.asc_nulls_last("tmag"), key).limit(n)


def priority_reasons(losses: DataFrame, gains: DataFrame, n: int, key: str = "injection_id") -> DataFrame:
    """Ranking-loss rows before newly recoverable ones, first per id, by (reason, S/N desc, gain desc)."""
    cols = [key, "best_snr", "gain"]
    u = losses.select(*cols, F.lit("ranking_loss").alias("reason")).unionByName(gains.select(*cols, F.lit("recoverable_gain").alias("reason")))
    first = first_by(u, [key], F.col("reason"), desc_last("best_snr"))
    return first.orderBy("reason", F.desc_nulls_last("best_snr"), F.desc_nulls_last("gain"), key).limit(n)


def spanning_rows(df: DataFrame, n: int, n_period: int, n_radius: int, key: str) -> DataFrame:
    """One row per (period bin, strided radius bin) pass; a pass is a permutation of the radius bins."""
    from math import gcd
    stride = max((s for s in range(1, max(2, n_radius)) if gcd(s, n_radius) == 1), default=1)
    slots = [(i % n_period, (stride * (i % n_period) + i // n_period) % n_radius) for i in range(n)]
    need: dict[tuple[int, int], int] = {}
    for s in slots:
        need[s] = need.get(s, 0) + 1
    quota = F.lit(0)
    for (p, q), k in need.items():
        quota = F.when((F.col("grid_period_bin") == p) & (F.col("grid_radius_bin") == q), k).otherwise(quota)
    top = per_stratum(df.where(quota > 0), ["grid_period_bin", "grid_radius_bin"], max(need.values()), [F.col(key)], "_r")
    return top.where(F.col("_r") <= quota).drop("_r")


def place_repeats(unique: DataFrame, repeats: DataFrame, seed: int, key: str, edge: int = 80, min_separation: int = 100) -> DataFrame:
    """Blind repeats at opposite ends of the display order, everything else shuffled by hash.

    Repeats (some tens) get positions from hash ranks inside the first and last ``edge`` slots; other rows fill the
    open slots in hash order.
    """
    r = [x[0] for x in repeats.select(key).orderBy(digest(F.col(key), seed + 7), key).limit(edge + 1).collect()]  # more than ``edge`` is refused below
    n = unique.count() + len(r)
    if n < 2 * edge + min_separation or len(r) > edge:
        raise ValueError(f"{n} rows cannot keep {len(r)} repeats {min_separation} apart")
    import hashlib
    rank = lambda tag, lo: sorted(range(lo, lo + edge), key=lambda p: hashlib.sha256(f"{seed}|{tag}|{p}".encode()).hexdigest())[:len(r)]
    low, high = rank("low", 0), rank("high", n - edge)
    half = len(r) // 2
    first = [low[i] if i < half else high[i] for i in range(len(r))]
    second = [high[i] if i < half else low[i] for i in range(len(r))]
    taken = sorted(first + second)
    slot = lambda pos: F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in r]), F.array(*[F.lit(p) for p in pos])), F.col(key))
    rep = unique.join(repeats.select(key), key, "left_semi")
    orig = rep.withColumns({"display": slot(first).cast("bigint"), "is_repeat": F.lit(False), "occurrence": F.lit("original")})
    dup = rep.withColumns({"display": slot(second).cast("bigint"), "is_repeat": F.lit(True), "occurrence": F.lit("blind_repeat")})
    rest = unique.join(repeats.select(key), key, "left_anti")
    rest = with_global_row_number(rest, [digest(F.col(key), seed), F.col(key)], "_p")
    # the p-th open slot skips every taken position at or before it
    shift = F.aggregate(F.array(*[F.lit(t).cast("bigint") for t in taken]), F.col("_p") - 1, lambda acc, t: F.when(t <= acc, acc + 1).otherwise(acc))
    rest = rest.withColumns({"display": shift, "is_repeat": F.lit(False), "occurrence": F.lit("single")}).drop("_p")
    return orig.unionByName(dup).unionByName(rest)


def host_cycles(hosts: DataFrame, n_attempts: int, seed: int, key: str = "tic") -> DataFrame:
    """Attempt sequence that uses every host once before any repeats: hash order per cycle."""
    one = cut_lineage(hosts.select(key).distinct())
    n = one.count()
    cycles = -(-n_attempts // max(1, n))
    d = one.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    d = d.withColumn("_h", digest(F.concat_ws("|", F.col("cycle").cast("string"), F.col(key).cast("string")), seed))
    order = [F.col("cycle"), F.col("_h"), F.col(key)]
    if n_attempts <= ONE_WINDOW_ROWS:  # a bounded top-k: the hosts beyond it need no order
        d = d.orderBy(*order).limit(n_attempts)
    return with_global_row_number(d, order, "attempt").where(F.col("attempt") <= n_attempts).drop("_h")
