"""Column contracts of training tables: one ordered aperture pair, no column of another product, ephemerides of the anchor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lumensift.functions import exprs as E
from lumensift.operators.skew import assert_unique


@dataclass(frozen=True)
class PairContract:
    """The apertures in order, the prefixes of their metrics, and what no column name may hold."""

    apertures: tuple[str, str]
    small: str = "small_"
    primary: str = "primary_"
    forbidden_part: str = "RAW_FLUX"
    allowed_part: str = "RAW_FLUX_DETRENDED"
    forbidden_prefixes: tuple[str, ...] = ("sml_",)
    dropped_prefixes: tuple[str, ...] = ("queue_", "selection_")
    dropped: tuple[str, ...] = ()
    agree_tol: float = 0.02
    #: generic column -> metric column that it is rewritten from
    rewritten: dict[str, str] = field(default_factory=lambda: {
        "period_d": "anchor_period_d", "t0_bjd": "anchor_t0_bjd", "duration_min": "anchor_duration_min",
        "depth": "small_depth", "depth_snr": "small_depth_snr", "sde_max": "small_sde", "rep_peak_rank": "small_peak_rank"})


def require_pair(apertures: Sequence[str], c: PairContract) -> tuple[str, str]:
    """The contract's pair; another pair or order raises before any job."""
    if tuple(str(a) for a in apertures) != c.apertures:
        raise ValueError(f"apertures must be {c.apertures}, not {tuple(apertures)}")
    return c.apertures


def forbidden_columns(columns: Sequence[str], c: PairContract) -> list[str]:
    """Names that belong to another product, sorted."""
    other = lambda n: c.forbidden_part in n.upper() and c.allowed_part not in n.upper()
    return sorted({n for n in columns if other(n) or n.startswith(c.forbidden_prefixes)})


def latest_metrics(tables: Sequence[DataFrame], c: PairContract, key: str = "review_id") -> DataFrame:
    """The last table's row of each id, with the metric columns of any table; the tables are in ascending priority, one row an id."""
    keep = (c.small, c.primary, "anchor_", "aperture_")
    parts = [t.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key), F.lit(i).alias("_at"), *[x for x in t.columns if x.startswith(keep)]) for i, t in enumerate(tables)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p, allowMissingColumns=True)
    names = [x for x in d.columns if x not in (key, "_at")]
    return d.groupBy(key).agg(F.max_by(F.struct(*names), "_at").alias("_m")).select(key, "_m.*")


def contract_frame(df: DataFrame, metrics: DataFrame, c: PairContract, key: str = "review_id") -> DataFrame:
    """The table with the anchor's ephemeris and metrics, a verdict per row and no column of another product.

    ``review_ok`` needs an anchor in the small aperture with its own peak, a displayed period equal to that peak's, and a peak in
    the primary one; ``exclusion_reason`` names the first that is missing. Rows that fail leave every include flag and the split.
    Columns that a metrics table lacks count as missing values.
    """
    assert_unique(df, [key], "rows")
    assert_unique(metrics, [key], "metrics")
    metrics = metrics.withColumn(key, F.col(key).cast("string"))
    d = df.drop(*[x for x in metrics.columns if x != key]).withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(""))).join(metrics, key, "left")
    num = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) if n in d.columns else F.lit(None).cast("double")
    yes = lambda x: F.coalesce(x, F.lit(False))
    small_p, primary_p = num(f"{c.small}period_d"), num(f"{c.primary}period_d")
    anchor = (F.col("anchor_aperture") == c.apertures[0]) if "anchor_aperture" in d.columns else F.lit(False)
    small_ok = yes(anchor & (num("anchor_period_d") > 0) & num("anchor_t0_bjd").isNotNull() & (num("anchor_duration_min") > 0) & (small_p > 0))
    shown = yes(E.period_relation(small_p, num("display_period_d")) == "exact")
    primary_ok = yes(primary_p > 0)
    agrees = primary_ok & yes(num("aperture_period_rel_delta") <= c.agree_tol)
    d = d.withColumns({"_small": small_ok, "_shown": shown, "_primary": primary_ok, "_agrees": agrees})
    ok = F.col("_small") & F.col("_shown") & F.col("_primary")
    reason = F.when(~F.col("_small"), "missing_small_anchor").when(~F.col("_shown"), "display_not_small_anchor").when(~F.col("_primary"), "missing_primary_supplement").otherwise("")
    new: dict[str, Column] = {"review_ok": ok, "exclusion_reason": reason, "rep_aperture": F.lit(c.apertures[0]),
                              "n_apertures_agree": F.when(~F.col("_primary"), 0).when(F.col("_agrees"), 2).otherwise(1),
                              "apertures_agree": F.when(F.col("_agrees"), ",".join(c.apertures)).when(F.col("_small"), c.apertures[0]).otherwise(""),
                              "min_pair_sde": F.least(num(f"{c.small}sde"), num(f"{c.primary}sde")),
                              **{to: num(source) for to, source in c.rewritten.items()}}
    for flag in ("main_include", "compact_include"):
        if flag in d.columns:
            new[flag] = E.text_bool(flag) & ok
    if "training_split" in d.columns:
        new["training_split"] = F.when(ok, F.col("training_split")).otherwise("unlabeled_or_audit")
    for shown_col in ("display_period_d", "display_t0_bjd", "display_duration_min"):
        if shown_col in d.columns:
            new[shown_col] = F.when(F.col("_small"), F.col(shown_col))
    out = d.withColumns(new)
    gone = {*forbidden_columns(out.columns, c), *c.dropped, *[x for x in out.columns if x.startswith(c.dropped_prefixes)], "_small", "_shown", "_primary", "_agrees"}
    return out.drop(*gone)


def contract_problems(df: DataFrame, c: PairContract, key: str = "review_id", included: Sequence[str] = ("main_include", "compact_include")) -> DataFrame:
    """(key, problem) of included rows that fail the verdict, name another aperture or have no usable ephemeris; bad columns raise."""
    bad = forbidden_columns(df.columns, c)
    if bad:
        raise ValueError(f"columns of another product: {bad}")
    use = F.lit(False)
    for flag in included:
        if flag in df.columns:
            use = use | E.text_bool(flag)
    usable = (F.col("period_d") > 0) & F.col("t0_bjd").isNotNull() & (F.col("duration_min") > 0)
    problem = F.when(~F.coalesce(F.col("review_ok"), F.lit(False)), "not_ok").when(F.col("rep_aperture") != c.apertures[0], "other_aperture").when(~F.coalesce(usable, F.lit(False)), "no_ephemeris")
    return df.where(use).select(key, problem.alias("problem")).where("problem IS NOT NULL")
