"""Set operations: registries, roles, folds, splits, holdouts and shards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lumensift.functions.hashing import digest, stable_fold
from lumensift.operators.ordering import cut_lineage, with_global_row_number
from lumensift.operators.select import per_stratum
from lumensift.operators.skew import with_row


def union_registry(sets: Sequence[tuple[str, DataFrame]], key: str = "tic", disjoint: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Union of id sets with membership flags; the earliest set names the role. Overlap of a disjoint pair is an error."""
    flagged = None
    for name, df in sets:
        one = df.select(key).withColumn("_in", F.lit(name))
        flagged = one if flagged is None else flagged.unionByName(one)
    out = flagged.groupBy(key).agg(*[F.bool_or(F.col("_in") == n).alias(f"in_{n}") for n, _ in sets])
    role = None
    for n, _ in sets:
        role = F.when(F.col(f"in_{n}"), n) if role is None else role.when(F.col(f"in_{n}"), n)
    out = out.withColumn("role", role)
    for a, b in disjoint:
        if not out.where(F.col(f"in_{a}") & F.col(f"in_{b}")).isEmpty():
            raise ValueError(f"{a} and {b} share targets")
    return out


def require_minimum(df: DataFrame, n: int, key: str = "tic") -> DataFrame:
    """Fail closed when fewer than ``n`` distinct keys remain."""
    have = df.select(key).distinct().limit(n).count()
    if have < n:
        raise ValueError(f"only {have} distinct {key}; need {n}")
    return df


def rank_in_cell_roles(schedule: DataFrame, cell: str, key: str, seed: int, n_holdout: int = 2, n_folds: int = 5) -> DataFrame:
    """First hash ranks of each cell are the locked holdout; the rest gets hash folds.

    Only the holdout needs ranks, so the rank filter is cut map-side and joined back.
    """
    first = per_stratum(schedule.select(cell, key), [cell], n_holdout, [digest(F.col(key), seed), F.col(key)], "_r").select(key, F.lit(True).alias("_h"))
    d = schedule.join(first, key, "left")
    held = F.col("_h").isNotNull()
    return d.withColumns({"partition": F.when(held, "locked_holdout").otherwise("development"), "fixed_split": F.when(held, "test").otherwise("development"),
                          "cv_fold": F.when(held, F.lit(-1).cast("bigint")).otherwise(stable_fold(F.col(key), seed + 1, n_folds))}).drop("_h")


def disjoint_splits(df: DataFrame, key: str, validation: float, test: float, seed: int) -> DataFrame:
    """Whole ids to train, validation and test: hash order over distinct ids, rounded cut points with minimums."""
    ids = cut_lineage(df.select(key).distinct())  # counted, cut into ranges and ordered: three reads
    n = ids.count()
    n_test = n_val = 0
    if n >= 3:
        n_test = min(max(round(test * n), 1 if test > 0 else 0), n - 2)
        n_val = min(max(round(validation * n), 1 if validation > 0 else 0), n - n_test - 1)
    r = with_global_row_number(ids, [digest(F.col(key), seed), F.col(key)], "_r")
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "validation").otherwise("train")
    return df.join(r.select(key, split.alias("split")), key)


def stratified_splits(df: DataFrame, strata: Sequence[str], key: str, validation: float, test: float, seed: int) -> DataFrame:
    """Per-stratum rounded shares with minimums.

    Cut points per stratum come from its size; a row's side comes from its hash rank. Ranks are counted inside
    hash prefixes plus prefix offsets, so a stratum of any size is spread over tasks.
    """
    strata = list(strata)
    d = df.withColumn("_h", digest(F.col(key), seed)).withColumn("_pre", F.substring("_h", 1, 3))
    pre = d.groupBy(*strata, "_pre").agg(F.count(F.lit(1)).alias("_n"))
    pre = pre.withColumn("_off", F.coalesce(F.sum("_n").over(W.partitionBy(*strata).orderBy("_pre").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    pre = pre.withColumn("_size", F.sum("_n").over(W.partitionBy(*strata))).drop("_n")
    d = d.join(pre, [*strata, "_pre"])
    rank = F.col("_off") + F.row_number().over(W.partitionBy(*strata, "_pre").orderBy("_h", key))
    n = F.col("_size")
    share = lambda f, room: F.when((room >= 3) & F.lit(f > 0), F.greatest(F.lit(1.0), F.rint(F.lit(f) * n))).otherwise(F.rint(F.lit(f) * n))
    want = share(test, n)
    t = F.least(want, F.greatest(F.lit(0), n - 1))
    v = share(validation, n - want)
    v = F.least(v, F.greatest(F.lit(0), n - t - 1))
    d = d.withColumns({"_rk": rank, "_t": t, "_v": v})
    split = F.when(F.col("_rk") <= F.col("_t"), "test").when(F.col("_rk") <= F.col("_t") + F.col("_v"), "validation").otherwise("train")
    return d.withColumn("split", split).drop("_h", "_pre", "_off", "_size", "_rk", "_t", "_v")


def grouped_folds(df: DataFrame, group: str, label: str, n_folds: int, seed: int) -> DataFrame:
    """Whole groups to folds, rarest labels first, each to the fold with the least of that label.

    Groups are reduced to (rarest label, size class) kinds; inside a kind they are dealt in hash order, which
    balances labels and sizes without walking single groups on the driver.
    """
    freq = df.groupBy(label).agg(F.count(F.lit(1)).alias("_f"))
    d = df.select(group, label).join(freq, label)
    g = d.groupBy(group).agg(F.min(F.struct("_f", label)).alias("_rare"), F.count(F.lit(1)).alias("_size"))
    g = g.select(group, F.col(f"_rare.{label}").alias("_lab"), F.floor(F.log2(F.col("_size"))).alias("_sz"), digest(F.col(group), seed).alias("_h"))
    g = g.withColumn("_pre", F.substring("_h", 1, 3))
    pre = g.groupBy("_lab", "_sz", "_pre").agg(F.count(F.lit(1)).alias("_n"))
    pre = pre.withColumn("_off", F.coalesce(F.sum("_n").over(W.partitionBy("_lab", "_sz").orderBy("_pre").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    g = g.join(pre, ["_lab", "_sz", "_pre"])
    pos = F.col("_off") + F.row_number().over(W.partitionBy("_lab", "_sz", "_pre").orderBy("_h", group)) - 1
    fold = F.pmod(pos + F.pmod(F.xxhash64("_lab", "_sz"), F.lit(n_folds)), F.lit(n_folds)).cast("int")
    return df.join(g.select(group, fold.alias("fold")), group)


def group_vectors(df: DataFrame, group: str, label: str, n_folds: int, max_labels: int = 4096) -> DataFrame:
    """(group, size, vec, kind): rows per label of each group, scaled so that squared lengths are the cost of an imbalance.

    A label of ``t`` rows a fold counts 1 / t, the group's size a tenth of that. Empty groups are an error; a missing label is a
    label of its own. The list of labels is read by the driver, so their number is bounded.
    """
    d = df.select(F.col(group).alias("_g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_l"))
    if not d.where(F.col("_g").isNull() | (F.trim(F.col("_g").cast("string")) == "")).isEmpty():
        raise ValueError(f"{group} has empty ids")
    counts = d.groupBy("_g", "_l").agg(F.count(F.lit(1)).alias("_n"))
    totals = sorted((r["_t"], r["_l"]) for r in counts.groupBy("_l").agg(F.sum("_n").alias("_t")).limit(max_labels + 1).collect())
    if len(totals) > max_labels:
        raise ValueError(f"{label} has more than {max_labels} values")
    g = counts.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_l", "_n"))).alias("_m"), F.sum("_n").alias("size"))
    of = lambda name: F.coalesce(F.col("_m")[name], F.lit(0))
    scale = lambda total: max(total / n_folds, 1.0) ** -0.5
    vec = [of(name) * F.lit(scale(t)) for t, name in totals] + [F.col("size") * F.lit(0.1 ** 0.5 * scale(sum(t for t, _ in totals)))]
    # rarest label first, many rows first: neighbours in this order are alike
    kind = F.concat_ws(",", *[F.lpad((F.lit(10 ** 15) - of(name)).cast("string"), 16, "0") for _, name in totals])
    return g.select(F.col("_g").alias(group), "size", F.array(*vec).alias("vec"), kind.alias("kind"))


def _turn(n_folds: int, block: int):
    """Walk the items of a block in order; each is turned so that it adds least to the imbalance so far."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        state, turns = None, []
        for m in pdf["dev"]:
            dev = np.array([np.asarray(x, dtype=float) for x in m])
            state = np.zeros_like(dev) if state is None else state
            cross = [float((state * np.roll(dev, s, axis=0)).sum()) for s in range(n_folds)]
            turns.append(int(np.argmin(cross)))
            state = state + np.roll(dev, turns[-1], axis=0)
        dev = [None] * (len(turns) - 1) + [state.tolist()]
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "turn": turns, "block": pdf["item"].to_numpy() // block, "dev": dev})
    return run


def balanced_assignment(df: DataFrame, group: str, label: str, n_folds: int, seed: int, block: int | None = None) -> DataFrame:
    """(group, bundle, vec, fold) with balanced label counts and sizes; whole groups, any number of them.

    Groups are ordered by their label vectors and cut into bundles of ``n_folds``, one group a fold. A bundle is turned against the
    imbalance of those before it; the turns of a bundle's deviation sum to zero over all turns, so the best one adds no more than its
    own square. Hence the bound: the final squared imbalance is at most the sum of the bundles' own, and bundles of equal
    groups add nothing. Bundles are walked in blocks, the blocks' imbalances are turned against each other in the same way, level
    by level, so that no task walks more than a block; the bound holds over all levels.
    """
    if n_folds < 2:
        raise ValueError("two folds at least")
    v = group_vectors(df, group, label, n_folds)
    v = with_global_row_number(v, [F.col("kind"), digest(F.col(group), seed), F.col(group)], "_p")
    v = cut_lineage(v.select(group, "vec", F.floor((F.col("_p") - 1) / n_folds).alias("bundle"), F.pmod(F.col("_p") - 1, F.lit(n_folds)).cast("int").alias("slot")))
    first = v.select(F.size("vec").alias("k")).first()
    if first is None:
        return v.select(group, "bundle", "vec", F.lit(0).alias("fold"))
    wide = first["k"]
    block = block or max(16, min(2048, 2_000_000 // (n_folds * wide)))
    zero = F.array_repeat(F.lit(0.0), wide)
    m = v.groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct("slot", "vec"))).alias("_m"))  # n_folds entries
    rows = F.array(*[F.coalesce(F.col("_m")[i], zero) for i in range(n_folds)])
    mean = F.aggregate(rows, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q / n_folds))
    items = m.select(F.col("bundle").alias("item"), rows.alias("_r"), mean.alias("_mean"))
    items = items.select("item", F.transform("_r", lambda x: F.zip_with(x, F.col("_mean"), lambda p, q: p - q)).alias("dev"))
    out, at = v.withColumns({"fold": F.col("slot"), "_at": F.col("bundle")}), None
    while True:
        step = cut_lineage(items.withColumn("_b", F.floor(F.col("item") / block)).groupBy("_b").applyInPandas(
            _turn(n_folds, block), "item bigint, turn int, block bigint, dev array<array<double>>"))
        out = out.join(step.select(F.col("item").alias("_at"), "turn", "block"), "_at").withColumns({"fold": F.pmod(F.col("fold") + F.col("turn"), F.lit(n_folds)), "_at": F.col("block")}).drop("turn", "block")
        items = step.where("dev IS NOT NULL").select(F.col("block").alias("item"), "dev")
        if len(items.limit(2).collect()) < 2:
            return out.select(group, "bundle", "vec", F.col("fold").cast("int").alias("fold"))


def balanced_folds(df: DataFrame, group: str, label: str, n_folds: int, seed: int) -> DataFrame:
    """Rows with the fold of their group, see ``balanced_assignment``."""
    return df.join(balanced_assignment(df, group, label, n_folds, seed).select(group, "fold"), group)


def holdout_and_cv_folds(df: DataFrame, group: str, label: str, seed: int, n_folds: int = 5) -> DataFrame:
    """A fixed test part of one fold in ``n_folds`` and as many balanced folds of the rest (-1 for the test part)."""
    outer = balanced_assignment(df, group, label, n_folds, seed).select(group, "fold")
    d = df.join(outer, group)
    inner = balanced_assignment(d.where("fold > 0"), group, label, n_folds, seed + 1).select(group, F.col("fold").alias("cv_fold"))
    return d.join(inner, group, "left").withColumns({"fixed_split": F.when(F.col("fold") == 0, "test").otherwise("development"), "cv_fold": F.coalesce("cv_fold", F.lit(-1))}).drop("fold")


def balance_report(assignment: DataFrame, n_folds: int) -> DataFrame:
    """One row: groups, groups in two folds, squared imbalance of the folds and the bound that it never passes.

    Per element of the vectors: sum over folds of squares minus the square of the sum over ``n_folds``.
    """
    e = assignment.select("fold", "bundle", F.posexplode("vec").alias("at", "x"))
    spread = F.sum(F.col("s") * F.col("s")) - F.sum("s") * F.sum("s") / n_folds
    final = e.groupBy("fold", "at").agg(F.sum("x").alias("s")).groupBy("at").agg(spread.alias("c")).agg(F.sum("c").alias("imbalance"))
    own = e.withColumnRenamed("x", "s").groupBy("bundle", "at").agg(spread.alias("c")).agg(F.sum("c").alias("bound"))
    group = assignment.columns[0]
    ids = assignment.groupBy(group).agg(F.countDistinct("fold").alias("f")).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("f") > 1).alias("n_split"))
    return ids.transform(with_row, final).transform(with_row, own)


def host_disjoint_holdout(manifest: DataFrame, training: DataFrame, cells: Sequence[str], min_support: int) -> tuple[DataFrame, DataFrame]:
    """Rows without training ids or hosts, and the support per manifest cell (zero cells fail)."""
    out = manifest.join(training.select("injection_id").distinct(), "injection_id", "left_anti").join(training.select("tic").distinct(), "tic", "left_anti")
    have = out.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))
    support = manifest.select(*cells).distinct().join(have, list(cells), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out, support.withColumn("supported", F.col("n") >= min_support)


def balanced_shards(df: DataFrame, n_shards: int, key: str, seed: int | None = None) -> DataFrame:
    """Equal-size shards, contiguous by key or in hash order."""
    n = df.count()
    size = -(-n // n_shards)
    order = [digest(F.col(key), seed), F.col(key)] if seed is not None else [F.col(key)]
    return with_global_row_number(df, order, "_p").withColumn("shard", F.floor((F.col("_p") - 1) / size).cast("int")).drop("_p")


def deal_to_cells(hosts: DataFrame, stratum: str, n_cells: int, capacity: int | None, key: str, seed: int) -> DataFrame:
    """Hosts dealt to grid cells stratum by stratum in hash order; no cell passes its capacity. Without one, cells have the slots that all hosts need."""
    n = hosts.count()
    if capacity is None:
        capacity = max(1, -(-n // n_cells))
    if n > n_cells * capacity:
        raise ValueError(f"{n} hosts exceed {n_cells} x {capacity} slots")
    d = with_global_row_number(hosts, [F.col(stratum), digest(F.col(key), seed), F.col(key)], "_p")
    slot = F.floor((F.col("_p") - 1) / n_cells)
    # each pass walks the cells from a different start
    cell = F.pmod(F.col("_p") - 1 + slot * 7, F.lit(n_cells))
    return d.withColumns({"grid_cell_index": cell.cast("int"), "grid_slot": slot.cast("int")}).withColumn(
        "injection_index", F.col("grid_cell_index") * capacity + F.col("grid_slot")).drop("_p")


def role_union(positives: DataFrame, paired: DataFrame, negatives: DataFrame, quotas: dict[str, int], seed: int, key: str = "review_id", klass: str = "label") -> DataFrame:
    """Positives, their paired originals and class-quota negatives as one table with a role."""
    neg = None
    for c, n in quotas.items():
        part = negatives.where(F.col(klass) == c).orderBy(digest(F.col(key), seed), key).limit(n)
        neg = part if neg is None else neg.unionByName(part)
    tag = lambda d, r: d.withColumn("role", F.lit(r))
    return tag(positives, "positive").unionByName(tag(paired, "paired_original"), allowMissingColumns=True).unionByName(tag(neg, "real_negative"), allowMissingColumns=True)
