"""Writers: fixed column orders, partition layouts, manifests and loss checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import reduce
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumensift.operators.gates import content_hash
from lumensift.operators.skew import assert_unique
from lumensift.operators.splits import balanced_shards
from lumensift.sources.tables import PEAK_COLUMNS, PEAK_TYPES

# sentinels appear only here
SENTINELS = {T.LongType(): -1, T.IntegerType(): -1, T.StringType(): ""}


def with_sentinels(df: DataFrame) -> DataFrame:
    """-1 in ids and '' in text for readers that know no NULL."""
    cols = {}
    for f in df.schema.fields:
        for t, v in SENTINELS.items():
            if f.dataType == t:
                cols[f.name] = F.coalesce(F.col(f.name), F.lit(v).cast(t))
    return df.withColumns(cols) if cols else df


def peak_table(df: DataFrame) -> DataFrame:
    """The fixed peak columns in order and with fixed types; absent ones NULL."""
    kind = lambda c: PEAK_TYPES.get(c, "double")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind(c)).alias(c) for c in PEAK_COLUMNS])


def write_peaks(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    peak_table(df).write.mode(mode).option("compression", "zstd").partitionBy("sector").parquet(path)


def write_spectra(spec: DataFrame, subset: DataFrame, path: str) -> None:
    """Full spectra for chosen targets only; the choice is a semi join before the write."""
    if "sector" not in spec.columns:
        raise ValueError("spectra need the sector they were searched in")
    spec.join(subset.select("tic").distinct(), "tic", "left_semi").write.mode("errorifexists").partitionBy("sector").parquet(path)


def write_product(df: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """Detrended product by sector and orbit; every target must have all columns on all rows. Returns per-target counts."""
    counts = df.groupBy("tic").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull() & (F.col("quality") == 0)).alias(f"n_null_{c}") for c in columns])
    if not df.groupBy("tic", "aperture", "cadenceno").count().where("count > 1").isEmpty():
        raise ValueError("product repeats cadences")
    short = counts.where(F.greatest(*[F.col(f"n_null_{c}") for c in columns], F.lit(0)) > 0) if columns else counts.limit(0)
    if examples := [r["tic"] for r in short.select("tic").limit(5).collect()]:
        raise ValueError(f"product lacks values on good cadences of {examples}")
    frame = [c for c in ("sector", "orbitid", "tic", "aperture", "cadenceno", "time", "quality") if c in df.columns]
    df.select(*frame, *[c for c in columns if c not in frame]).write.mode("errorifexists").option("compression", "zstd").partitionBy("sector", "orbitid").parquet(path)
    return counts


def compact_export(df: DataFrame, columns: Sequence[str], path: str, keep: DataFrame | None = None) -> DataFrame:
    """Chosen columns of chosen targets, range-partitioned by target; returns exported and skipped counts."""
    d = df.select("tic", *[c for c in columns if c != "tic"])
    if keep is not None:
        k = keep.select("tic").distinct().withColumn("_k", F.lit(True))
        status = df.select("tic").distinct().join(k, "tic", "full_outer").groupBy(F.when(F.col("_k").isNull(), "skipped").otherwise("requested").alias("status")).count()
        d = d.join(k.drop("_k"), "tic", "left_semi")
    else:
        status = df.select("tic").distinct().groupBy(F.lit("requested").alias("status")).count()
    d.repartitionByRange("tic").write.mode("errorifexists").parquet(path)
    return status


def write_by_detector(df: DataFrame, path: str) -> None:
    """One folder per (orbit, camera, ccd); hash repartition on the same columns keeps files few, AQE splits a hot one."""
    df.hint("rebalance", "orbit", "camera", "ccd").write.mode("errorifexists").partitionBy("orbit", "camera", "ccd").parquet(path)


def strict_json(row: DataFrame, path: str) -> None:
    """A one-row report as JSON with sorted keys; NaN and infinities become null."""
    cols = []
    for c in sorted(row.columns):
        t = row.schema[c].dataType
        v = F.col(c)
        if isinstance(t, (T.DoubleType, T.FloatType)):
            v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
        cols.append(v.alias(c))
    row.limit(1).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_versioned(df: DataFrame, path: str, version: str, columns: Sequence[str], sources: dict[str, str] | None = None, overwrite: bool = False) -> None:
    """Table to a new folder plus a manifest with row count and content hash; existing versions are refused.

    The manifest is written last, so a folder without one is an unfinished write.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).parquet(f"{path}/data")
    back = df.sparkSession.read.parquet(f"{path}/data")
    m = content_hash(back, columns).withColumns({"version": F.lit(version), "written_utc": F.lit(datetime.now(timezone.utc).isoformat()), **{f"source_{k}": F.lit(v) for k, v in (sources or {}).items()}})
    if overwrite:
        m.select(F.to_json(F.struct(*sorted(m.columns))).alias("value")).write.mode("overwrite").text(f"{path}/manifest")
    else:
        strict_json(m, f"{path}/manifest")


class InputChanged(RuntimeError):
    """An input was altered while a table was made from it."""


def input_fingerprint(df: DataFrame) -> DataFrame:
    """One row that tells two states of an input apart: rows, files, and sums of row hashes that need no order and merge in each task.

    Doubled rows count; column order doesn't. Files are identified by path, size and time where the input is made of files.
    """
    cols = [F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in sorted(df.columns)]
    big = lambda c: c.cast("decimal(20,0)")
    f = F.col("_metadata")
    d = df.select(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7), *cols).alias("b"), F.struct(f["file_path"].alias("p"), f["file_size"].alias("s"), f["file_modification_time"].alias("t")).alias("file"))
    per = d.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(big(F.col("a"))).alias("a"), F.sum(big(F.col("b"))).alias("b"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sum("a").cast("string").alias("sum_a"), F.sum("b").cast("string").alias("sum_b"),
                   F.sum(big(F.xxhash64(F.to_json("file")))).cast("string").alias("files"))


def _read_fingerprints(spark: SparkSession, inputs: dict[str, str]) -> dict[str, dict]:
    # listed anew each time: a cached listing would hide files that came or went
    out = {}
    for name, path in inputs.items():
        spark.catalog.refreshByPath(path)
        out[name] = input_fingerprint(spark.read.parquet(path)).first().asDict()
    return out


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, build: Callable[[dict[str, DataFrame]], DataFrame], inputs: dict[str, str], path: str, version: str, columns: Sequence[str]) -> dict:
    """Make a table from Parquet inputs and publish it with its manifest, or publish nothing.

    Table and manifest are written to a staging folder beside ``path``; inputs are fingerprinted before and after, and a change is refused
    (``InputChanged``). One rename of the folder is the commit, so a reader sees all of a version or none, and a job that was lost leaves only a
    staging folder. Existing versions and outputs inside an input (or around one) are refused.
    """
    clean = lambda p: p.rstrip("/") + "/"
    if any(clean(path).startswith(clean(i)) or clean(i).startswith(clean(path)) for i in inputs.values()):
        raise ValueError("output path collides with an input")
    fs, final = _file_system(spark, f"{path.rstrip('/')}/{version}")
    if fs.exists(final):
        raise FileExistsError(f"{path} has a version {version}")
    before = _read_fingerprints(spark, inputs)
    stage = f"{path.rstrip('/')}/_staging-{version}-{os.urandom(4).hex()}"
    _, staged = _file_system(spark, stage)
    try:
        build({k: spark.read.parquet(p) for k, p in inputs.items()}).write.parquet(f"{stage}/data")
        h = content_hash(spark.read.parquet(f"{stage}/data"), columns).first()
        changed = sorted(k for k, v in _read_fingerprints(spark, inputs).items() if v != before[k])
        if changed:
            raise InputChanged(f"inputs changed during the run: {changed}")
        manifest = {"version": version, "n_distinct_rows": h.n_rows or 0, "content_sha256": h.content_sha256, "columns": sorted(columns), "inputs": before, "written_utc": datetime.now(timezone.utc).isoformat()}
        spark.range(1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{stage}/manifest")
        if fs.exists(final) or not fs.rename(staged, final):
            raise FileExistsError(f"{path} has a version {version}")
    except BaseException:
        fs.delete(staged, True)
        raise
    return manifest


def read_published(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A published version, once its content agrees with its manifest."""
    root = f"{path.rstrip('/')}/{version}"
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{root}/manifest").collect()))
    df = spark.read.parquet(f"{root}/data")
    h = content_hash(df, manifest["columns"]).first()
    if ((h.n_rows or 0), h.content_sha256) != (manifest["n_distinct_rows"], manifest["content_sha256"]):
        raise ValueError(f"{root} differs from its manifest")
    return df


def write_shards(df: DataFrame, path: str, n_shards: int, key: str) -> None:
    balanced_shards(df, n_shards, key).write.mode("errorifexists").partitionBy("shard").parquet(path)


def merge_shards(parts: Sequence[DataFrame], expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of shards; its keys must be exactly the expected ones, without repeats."""
    u = assert_unique(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), keys, "merged shards")
    want, got = expected.select(*keys).distinct(), u.select(*keys)
    diff = want.withColumn("_w", F.lit(True)).join(got.withColumn("_g", F.lit(True)), list(keys), "full_outer").where("_w IS NULL OR _g IS NULL").limit(5).collect()
    if diff:
        raise ValueError(f"shards lost or gained keys: {diff}")
    return u


def merge_chunks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunk tables as one; a key set that occurs in two chunks is an error."""
    bad = chunks.groupBy(*keys).agg(F.countDistinct("chunk").alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"keys repeat across chunks: {bad}")
    return chunks.drop("chunk")


def write_blinded(public: DataFrame, hidden: DataFrame, path: str, secret: Sequence[str]) -> None:
    """Public queue and hidden provenance in separate folders; secret columns in the public part are an error."""
    leaked = [c for c in public.columns if c in secret]
    if leaked:
        raise ValueError(f"public queue exposes {leaked}")
    public.write.mode("errorifexists").parquet(f"{path}/public")
    hidden.write.mode("errorifexists").parquet(f"{path}/hidden")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")
