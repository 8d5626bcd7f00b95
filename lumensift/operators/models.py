"""Features, preprocessing and classifiers on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lumensift.functions import consts as K
from lumensift.operators import metrics as M, robust, skew
from lumensift.operators.ordering import cut_lineage
from lumensift.session import hot_rows, task_count

# fixed deny and allow rules for features
DENY_EXACT = ("label", "target", "split", "review_id", "injection_id", "match_kind", "is_signal")
DENY_PREFIX = ("truth_", "human_", "adjudicated_", "source_", "p_", "std_p_")
LEAK_TOKENS = ("truth", "target", "role", "label")


def leakage_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in DENY_EXACT or c.startswith(DENY_PREFIX)]


def assert_no_leakage(columns: Sequence[str]) -> None:
    bad = [c for c in columns if any(t in c.lower() for t in LEAK_TOKENS)]
    if bad:
        raise ValueError(f"feature columns carry outcome information: {bad}")


def shape_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if re.match(r"^shape_[a-z]+_\d+$", c)]


#: Rows that a task ranks, where rows are counted.
TASK_ROWS = 500_000


def peak_features(df: DataFrame, group: str | None = None, hot: bool | None = None) -> DataFrame:
    """Logs, inverse rank, in-group ranks and ratios; absent columns become NULL.

    A minimum-tie rank is one plus the number of better rows. Groups that fit a task are ranked in windows that share one exchange;
    with a ``hot`` group (None: rows are counted) ranks come from the distinct values of a group, pre-aggregated map-side. Counted rows are
    dealt over tasks of about TASK_ROWS, whose sorts stay in memory whatever the size of the table; logs are taken after the exchange.
    """
    for c in ("peak_rank", "period_d", "duration_min", "depth", "depth_snr", "sde", "log_power"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    log = lambda c: F.when(c > 0, F.log10(F.when(c > 0, c)))
    logs = {"rank_inv": F.when(F.col("peak_rank") > 0, 1.0 / F.nullif("peak_rank", F.lit(0))), "log_period_d": log(F.col("period_d")),
                        "log_duration_min": log(F.col("duration_min")), "log_abs_depth": log(F.abs("depth")), "log_depth_snr": log(F.col("depth_snr")), "log_sde": log(F.col("sde"))}
    if group is None:
        return df.withColumns(logs)
    d, tasks = df.withColumn("abs_depth", F.abs("depth")), None
    if hot is None:
        most, n = skew.group_sizes(df, [group]).agg(F.max("group_rows"), F.sum("group_rows")).first()
        hot, tasks = (most or 0) > hot_rows(df.sparkSession), -(-(n or 0) // TASK_ROWS)
    if not hot:
        if tasks is not None:
            d = d.repartition(max(task_count(df.sparkSession), tasks), group)
        for c in ("sde", "depth_snr", "log_power", "abs_depth"):
            place = F.rank().over(W.partitionBy(group).orderBy(F.desc_nulls_last(c)))
            d = d.withColumn(f"{c}_group_rank_inv", F.when(F.col(group).isNotNull() & F.col(c).isNotNull(), 1.0 / place))
        for c in ("sde", "depth_snr", "abs_depth"):
            top = F.max(c).over(W.partitionBy(group))
            d = d.withColumn(f"{c}_over_group_max", F.when(F.col(group).isNotNull() & (top > 0), F.col(c) / F.nullif(top, F.lit(0.0))))
        return d.drop("abs_depth").withColumns(logs)
    d = d.withColumns(logs)
    for c in ("sde", "depth_snr", "log_power", "abs_depth"):
        v = d.where(F.col(c).isNotNull()).groupBy(group, c).agg(F.count(F.lit(1)).alias("_n"))
        w = W.partitionBy(group).orderBy(F.desc(c)).rowsBetween(W.unboundedPreceding, -1)
        v = v.withColumn(f"{c}_group_rank_inv", 1.0 / (1 + F.coalesce(F.sum("_n").over(w), F.lit(0)))).drop("_n")
        d = d.join(v, [group, c], "left")
    top = d.groupBy(group).agg(*[F.max(c).alias(f"_max_{c}") for c in ("sde", "depth_snr", "abs_depth")])
    d = d.join(top, group, "left")
    for c in ("sde", "depth_snr", "abs_depth"):
        d = d.withColumn(f"{c}_over_group_max", F.when(F.col(f"_max_{c}") > 0, F.col(c) / F.nullif(f"_max_{c}", F.lit(0.0))))
    return d.drop("abs_depth", *[f"_max_{c}" for c in ("sde", "depth_snr", "abs_depth")])


@dataclass(frozen=True)
class FeatureSpec:
    """Fitted robust scaling and category levels; a few numbers per column."""

    centres: dict[str, float]
    scales: dict[str, float]
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [*self.centres, *[f"{c}={v}" for c, vs in self.levels.items() for v in vs]]


def fit_spec(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), max_levels: int = 16) -> FeatureSpec:
    """Median centre; 1.4826 MAD, else std, else 1 as scale; most frequent levels. Fit rows only."""
    assert_no_leakage([*numeric, *categorical])
    num = [robust.finite_or_null(F.col(c).cast("double")).alias(c) for c in numeric]
    base = df.select(*num)
    row = robust.column_quantiles(base, numeric, 0.5)
    centre = {c: float(row[c]) if row[c] is not None else 0.0 for c in numeric}
    dev = base.select(*[F.abs(F.col(c) - centre[c]).alias(c) for c in numeric])
    mad = robust.column_quantiles(dev, numeric, 0.5)
    std = base.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first()
    scale = {}
    for c in numeric:
        s = K.MAD_SIGMA * (mad[c] or 0.0)
        scale[c] = s if s > 0 else (std[c] if std[c] and std[c] > 0 else 1.0)
    levels = {}
    for c in categorical:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(max_levels).collect()
        levels[c] = tuple(str(r[0]) for r in top)
    return FeatureSpec(centre, scale, levels)


def transform(df: DataFrame, spec: FeatureSpec, out: str = "features") -> DataFrame:
    """Scaled, clipped to +-8, missing to 0; one-hot for the kept levels."""
    cols, exprs = [], {}
    for i, c in enumerate(spec.centres):
        z = (F.col(c).cast("double") - spec.centres[c]) / spec.scales[c]
        exprs[f"_f{i}"] = F.coalesce(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), robust.finite_or_null(z))), F.lit(0.0))
    for c, vs in spec.levels.items():
        for v in vs:
            exprs[f"_f{len(exprs)}"] = F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0))
    cols = list(exprs)
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df.withColumns(exprs)).drop(*cols)


@dataclass
class Classifier:
    """Class names, preprocessing and weights; scoring is a column expression plus the ML transform."""

    classes: tuple[str, ...]
    spec: FeatureSpec
    model: LogisticRegressionModel

    def score(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        d = self.model.transform(transform(df, self.spec)).withColumn("_p", vector_to_array("probability"))
        d = d.withColumns({f"{prefix}{c}": F.col("_p")[i] for i, c in enumerate(self.classes)}).drop("_p", "features", "rawPrediction", "probability", "prediction")
        return M.score_predictions(d, {c: f"{prefix}{c}" for c in self.classes})

    def coefficients(self, spark) -> DataFrame:
        m = self.model.coefficientMatrix.toArray()
        rows = [(self.classes[i] if m.shape[0] > 1 else self.classes[-1], n, float(m[i, j]), abs(float(m[i, j]))) for i in range(m.shape[0]) for j, n in enumerate(self.spec.names())]
        return spark.createDataFrame(rows, "label string, feature string, coefficient double, magnitude double").orderBy(F.desc("magnitude"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/weights")
        spark = SparkSession.active()
        # arrays keep the column order of the weights
        num = [(c, self.spec.centres[c], self.spec.scales[c]) for c in self.spec.centres]
        cat = [(c, list(v)) for c, v in self.spec.levels.items()]
        spark.createDataFrame([(list(self.classes), num, cat)], "classes array<string>, numeric array<struct<name: string, centre: double, scale: double>>, levels array<struct<name: string, kept: array<string>>>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")

    @staticmethod
    def load(spark, path: str) -> "Classifier":
        r = spark.read.parquet(f"{path}/spec").first()
        spec = FeatureSpec({n["name"]: n["centre"] for n in r["numeric"]}, {n["name"]: n["scale"] for n in r["numeric"]}, {c["name"]: tuple(c["kept"]) for c in r["levels"]})
        return Classifier(tuple(r["classes"]), spec, LogisticRegressionModel.load(f"{path}/weights"))


def train(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), l2: float = 1e-2, cap: float = 4.0, max_iter: int = 50,
          weight: str | None = None) -> Classifier:
    """Weighted multinomial logistic regression with balanced classes; distributed L-BFGS."""
    classes = tuple(r[0] for r in df.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().orderBy(label).collect())
    spec = fit_spec(df, numeric, categorical)
    d = M.class_weights(df, label, cap)
    w = F.col("weight") if weight is None else F.col("weight") * F.col(weight)
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1
    d = transform(d, spec).withColumns({"_y": idx.cast("double"), "_w": w}).select("features", "_y", "_w")
    lr = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", family="multinomial", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return Classifier(classes, spec, lr.fit(d))


PEAK_NUMERIC = ("rank_inv", "log_period_d", "log_duration_min", "log_abs_depth", "log_depth_snr", "log_sde", "sde_group_rank_inv", "depth_snr_group_rank_inv",
                "sde_over_group_max", "depth_snr_over_group_max")


def train_peak_ranker(labelled: DataFrame, group: str = "injection_id", hot: bool | None = None) -> Classifier:
    """Signal against noise peaks from engineered features; rows carry group-disjoint splits beforehand."""
    f = peak_features(labelled, group, hot).withColumn("signal", F.when(F.col("is_signal"), "signal").otherwise("noise"))
    # several passes follow (levels, scales, iterations), so the features are written once
    return train(cut_lineage(f.select("signal", *PEAK_NUMERIC)), "signal", PEAK_NUMERIC)


def rank_with(model: Classifier, peaks: DataFrame, group: str = "injection_id", hot: bool | None = None) -> DataFrame:
    return model.score(peak_features(peaks, group, hot), "p_")


def teacher_student(df: DataFrame, label: str, numeric: Sequence[str], pseudo_weight: float = 0.25, **pseudo) -> tuple[Classifier, Classifier, DataFrame]:
    """Teacher on human labels; confident unlabelled rows join at a reduced weight; student on both."""
    human = df.where(F.col(label).isNotNull())
    teacher = train(human, label, numeric)
    rest = teacher.score(df.where(F.col(label).isNull()))
    extra = M.pseudo_labels(rest, **pseudo).withColumn(label, F.col("predicted")).withColumn("_pw", pseudo_weight * F.col("confidence"))
    both = human.withColumn("_pw", F.lit(1.0)).select(*df.columns, "_pw").unionByName(extra.select(*df.columns, "_pw"))
    return teacher, train(both, label, numeric, weight="_pw"), extra


def logistic_boundary(df: DataFrame, recovered: str, x1: Column, x2: Column, ridge: float = 1.0) -> tuple[DataFrame, dict[str, float]]:
    """Two-feature ridge boundary on standardised axes; returns scored rows and raw-unit coefficients."""
    d = df.select("*", x1.cast("double").alias("_x1"), x2.cast("double").alias("_x2")).where(robust.finite(F.col("_x1")) & robust.finite(F.col("_x2")))
    s = d.agg(F.avg("_x1").alias("m1"), F.stddev_pop("_x1").alias("s1"), F.avg("_x2").alias("m2"), F.stddev_pop("_x2").alias("s2"), F.count(F.lit(1)).alias("n")).first()
    z = d.withColumns({"_z1": (F.col("_x1") - s["m1"]) / (s["s1"] or 1.0), "_z2": (F.col("_x2") - s["m2"]) / (s["s2"] or 1.0), "_y": F.col(recovered).cast("double")})
    v = VectorAssembler(inputCols=["_z1", "_z2"], outputCol="features").transform(z)
    m = LogisticRegression(labelCol="_y", regParam=ridge / s["n"], elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-10).fit(v)
    b1, b2 = m.coefficients[0] / (s["s1"] or 1.0), m.coefficients[1] / (s["s2"] or 1.0)
    coef = {"b1": float(b1), "b2": float(b2), "b0": float(m.intercept - b1 * s["m1"] - b2 * s["m2"])}
    out = d.withColumn("p", 1.0 / (1.0 + F.exp(-(coef["b0"] + coef["b1"] * F.col("_x1") + coef["b2"] * F.col("_x2"))))).drop("_x1", "_x2")
    return out, coef


def log_loss(df: DataFrame, p: str, truth: str) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    return df.agg(F.avg(F.when(F.col(truth), -F.log(q)).otherwise(-F.log(1 - q))).alias("log_loss"))
