"""Readers: explicit schemas, column pruning, NaN turned into NULL at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumensift.functions import exprs as E
from lumensift.operators.ordering import with_global_row_number
from lumensift.operators.robust import finite_or_null
from lumensift.operators.skew import assert_unique

CADENCES = T.StructType([T.StructField(n, t) for n, t in (
    ("sector", T.IntegerType()), ("tic", T.LongType()), ("aperture", T.StringType()), ("cadenceno", T.LongType()), ("time", T.DoubleType()), ("orbitid", T.IntegerType()),
    ("quality", T.IntegerType()), ("flux", T.DoubleType()), ("flux_err", T.DoubleType()), ("sap_x", T.DoubleType()), ("sap_y", T.DoubleType()), ("variant", T.StringType()))])

LABEL_LOG = T.StructType([T.StructField(n, T.StringType()) for n in (
    "row_id", "candidate_key", "tic", "sector", "label", "label_source", "labeler", "notes", "updated_utc", "period_factor", "period_status")])

#: fixed values: column order of the peak table, and the types of its columns that are not double
PEAK_COLUMNS = ("tic", "sector", "cam", "ccd", "tmag", "aperture", "peak_rank", "period_d", "t0_bjd", "duration_min", "depth", "depth_snr", "sde", "log_power",
                "n_cad_total", "n_cad_quality", "n_cad_edge_trimmed", "n_cad_sigma_clipped", "n_cad_kept", "dropout_frac", "quality_dropout_frac", "n_orbits", "baseline_d", "status",
                "path", "bls_run_id", "search_branch", "cfg_n_periods", "cfg_p_min_d", "cfg_p_max_cap_d", "cfg_max_period_fraction", "cfg_durations_min", "cfg_n_peaks", "cfg_period_mask_frac",
                "cfg_min_cadences", "cfg_sigma_clip", "cfg_orbit_edge_trim_d", "cfg_period_bin_edges")

PEAK_TYPES = {**dict.fromkeys(("sector", "cam", "ccd", "peak_rank", "n_orbits", "cfg_n_periods", "cfg_n_peaks", "cfg_min_cadences"), "int"), "tic": "bigint",
              **dict.fromkeys(("n_cad_total", "n_cad_quality", "n_cad_edge_trimmed", "n_cad_sigma_clipped", "n_cad_kept"), "bigint"),
              **dict.fromkeys(("aperture", "status", "path", "bls_run_id", "search_branch", "cfg_durations_min", "cfg_period_bin_edges"), "string")}


def clean_nulls(df: DataFrame) -> DataFrame:
    """NaN and infinities in float columns become NULL."""
    cols = {f.name: finite_or_null(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cols) if cols else df


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path, length and time of every file below ``root``; file contents are not read.

    ``sector`` and ``tic`` come from an ``s0056-<id>`` token in the file name.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    num = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit("")).try_cast("bigint")
    return d.withColumns({"sector": num(r"s(\d{4})-"), "tic": num(r"s\d{4}-0*(\d+)"), "orbit": num(r"o(\d+)"), "cam": num(r"cam(\d)"), "ccd": num(r"ccd(\d)")})


def sector_files(spark: SparkSession, root: str, sector: int, glob: str = "*") -> DataFrame:
    return inventory(spark, root, glob).where(F.col("sector") == sector)


def files_by_target(inv: DataFrame) -> DataFrame:
    """One row per target with its sorted file list (files of a target are bounded by its orbits)."""
    return inv.where("tic IS NOT NULL").groupBy("tic").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def expected_paths(expected: DataFrame, inv: DataFrame) -> DataFrame:
    """(tic, orbit) expectations to files; state found, missing or ambiguous over detectors."""
    g = inv.groupBy("tic", "orbit").agg(F.countDistinct("cam", "ccd").alias("n_detectors"), F.min("path").alias("path"))
    n = F.coalesce("n_detectors", F.lit(0))
    return expected.join(g, ["tic", "orbit"], "left").withColumn("state", F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous"))


def curves(spark: SparkSession, path: str, apertures: Sequence[str] | None = None, columns: Sequence[str] = ("sector", "tic", "aperture", "cadenceno", "time", "orbitid", "quality", "flux")) -> DataFrame:
    """The long cadence table with only the asked columns; the aperture filter reaches the scan."""
    d = spark.read.schema(CADENCES).parquet(path)
    if apertures:
        d = d.where(F.col("aperture").isin(*apertures))
    return clean_nulls(d.select(*columns))


def injected_curves(spark: SparkSession, path: str) -> DataFrame:
    """Injected variant rows; a legacy single-flux column stands in where the aperture matches its attribute."""
    d = spark.read.parquet(path)
    if "flux_injected" in d.columns:
        flux = F.coalesce(F.when(F.col("variant") == "injected", F.col("flux")), F.when(F.col("aperture") == F.col("legacy_aperture"), F.col("flux_injected")))
        return clean_nulls(d.withColumn("flux", flux).where("flux IS NOT NULL"))
    return clean_nulls(d.where("variant = 'injected'"))


def target_catalog(df: DataFrame) -> DataFrame:
    """Distinct target metadata; empty tables and repeated targets are errors."""
    d = df.select("tic", "sector", "cam", "ccd", "tmag").distinct()
    if d.isEmpty():
        raise ValueError("target catalog is empty")
    return assert_unique(d, ["tic", "sector"], "target catalog")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet or CSV by suffix; CSV needs an explicit schema."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        return clean_nulls(spark.read.parquet(path))
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("CSV tables need a schema")
        return clean_nulls(spark.read.option("header", True).schema(schema).csv(path))
    raise ValueError(f"unsupported table suffix: {path}")


def read_label_log(spark: SparkSession, path: str) -> DataFrame:
    """Append-only CSV change log; bad row ids are dropped, absent columns read as NULL, file order kept as ``seq``.

    ``seq`` orders rows by file name, byte block and line, so a log of one file keeps its order, and later files win ties.
    """
    d = spark.read.option("header", True).csv(path)  # every column as text; casts below
    for f in LABEL_LOG.fields:
        if f.name not in d.columns:
            d = d.withColumn(f.name, F.lit(None).cast("string"))
    d = d.withColumns({"row_id": F.col("row_id").try_cast("double").cast("bigint"), "updated_utc": F.try_to_timestamp("updated_utc")})
    d = d.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return with_global_row_number(d.where("row_id IS NOT NULL"), [F.col("_file"), F.col("_block"), F.col("_line")], "seq").drop("_file", "_block", "_line")


def read_cadence_list(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace text whose first field is a cadence number."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].try_cast("bigint").alias("cadenceno")).where("cadenceno IS NOT NULL")


def read_flag_file(spark: SparkSession, path: str) -> DataFrame:
    """(cadence, flag) pairs; repeated cadences and non-integers are errors."""
    parts = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(parts[0].try_cast("bigint").alias("cadenceno"), F.try_element_at(parts, F.lit(2)).try_cast("int").alias("flag"), "value")
    bad = d.where("cadenceno IS NULL OR flag IS NULL").limit(5).collect()
    if bad:
        raise ValueError(f"bad flag rows: {[b['value'] for b in bad]}")
    return assert_unique(d.select("cadenceno", "flag"), ["cadenceno"], "flag file")


def read_include_list(spark: SparkSession, path: str) -> DataFrame:
    """Target ids from a list mixing ids and file paths; comments and repeats dropped."""
    tok = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")[0]
    d = spark.read.text(path).select(tok.alias("token")).where("token <> ''")
    tic = F.when(F.col("token").rlike("^[0-9]+$"), F.col("token").try_cast("bigint")).otherwise(F.nullif(F.regexp_extract("token", r"s\d{4}-0*(\d+)", 1), F.lit("")).try_cast("bigint"))
    return d.select(tic.alias("tic")).where("tic IS NOT NULL").distinct()


def read_summary(spark: SparkSession, path: str, schema: str = "source_id bigint, status string, tic bigint") -> DataFrame:
    d = assert_unique(spark.read.option("header", True).schema(schema).csv(path), ["source_id"], "summary")
    if d.isEmpty():
        raise ValueError(f"summary is empty: {path}")
    return d


def read_chunks(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All ``chunk_*/<table>`` tables with their chunk name."""
    return spark.read.parquet(f"{root}/chunk_*/{table}").withColumn("chunk", F.regexp_extract(F.col("_metadata.file_path"), r"/(chunk_[^/]+)/", 1))


def discover_hosts(inv: DataFrame, keep: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    d = inv.select("tic", "path").where("tic IS NOT NULL")
    if keep is not None:
        d = d.join(keep.select("tic").distinct(), "tic", "left_semi")
    if limit is not None:
        first = d.select("tic").distinct().orderBy("tic").limit(limit)
        d = d.join(first, "tic", "left_semi")
    return d


def detector_lookup(df: DataFrame, tics: DataFrame) -> DataFrame:
    """Target to detector of the product in use; two detectors for one target are an error."""
    d = df.join(tics.select("tic").distinct(), "tic", "left_semi").select("tic", "cam", "ccd").distinct()
    return assert_unique(d, ["tic"], "detector lookup")


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("candidate_key", E.candidate_key())
