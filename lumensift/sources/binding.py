"""Domain views over the driver's tables: every column is a deterministic expression.

A survey deployment reads these views from its own parquet tables (``sources.tables``);
the driver data has the same row shapes under other names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

APERTURES = ("SML", "PRI")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days() -> Column:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return us / F.lit(8.64e10)


def cadences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cadence table: one row per target, aperture and cadence."""
    ev = table(spark, sf_dir, "events")
    small = 1 + (F.col("value") - 50) / 1000
    prim = 1 + (F.col("value") * 0.8 + F.col("event_id") % 7 - 45) / 1000
    return (
        ev.select(
            F.lit(1).alias("sector"), F.col("user_id").alias("tic"), F.col("event_id").alias("cadenceno"),
            _days().alias("time"), F.floor(_days() / 13.7).cast("int").alias("orbitid"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("quality"),
            (10 + (F.col("event_id") % 13) / 100).alias("sap_x"), (20 + (F.col("event_id") % 17) / 100).alias("sap_y"),
            (F.col("value") / 10).alias("bkg"),
            F.explode(F.array(F.struct(F.lit("SML").alias("aperture"), small.alias("flux")),
                              F.struct(F.lit("PRI").alias("aperture"), prim.alias("flux")))).alias("a"))
        .select("sector", "tic", "a.aperture", "cadenceno", "time", "orbitid", "quality", "a.flux", "sap_x", "sap_y", "bkg")
    )


def raw_cadences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw per-orbit curve: magnitudes always, linear flux only on two of three cadences."""
    ev = table(spark, sf_dir, "events")
    mag = 17 - 2.5 * F.log10(1 + F.col("value") / 100)
    return ev.select(
        F.col("user_id").alias("tic"), F.floor(_days() / 13.7).cast("int").alias("orbit"),
        (1 + F.col("user_id") % 4).cast("int").alias("camera"), (1 + F.floor(F.col("user_id") / 4) % 4).cast("int").alias("ccd"),
        F.col("event_id").alias("cadenceno"), _days().alias("time"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("quality"),
        F.when(F.col("event_id") % 3 != 0, 100 + F.col("value")).alias("raw_flux"), mag.alias("raw_mag"),
        (16 + (F.col("user_id") % 40) / 10).alias("tmag"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search peaks; a third repeat a period tied to the target, some of them at twice that period."""
    li = table(spark, sf_dir, "lineitem")
    base = F.lit(0.12) + (F.col("l_orderkey") % 1500) / 100
    kind = F.col("l_partkey") % 5
    jitter = 1 + (F.col("l_suppkey") % 10 - 5) * 0.0005
    period = (F.when(kind == 0, base * jitter).when(kind == 1, 2 * base)
              .otherwise(F.lit(0.12) + (F.col("l_partkey") % 1500) / 100))
    t0 = (F.when(kind <= 1, 2457000 + (F.col("l_orderkey") % 50) / 10 + (F.col("l_linenumber") - 3) / 1440)
          .otherwise(2457000 + F.col("l_quantity") / 10))
    return li.select(
        F.col("l_orderkey").alias("tic"), F.lit(1).alias("sector"),
        (1 + F.col("l_orderkey") % 4).cast("int").alias("cam"),
        (1 + F.floor(F.col("l_orderkey") / 4) % 4).cast("int").alias("ccd"),
        (16 + (F.col("l_orderkey") % 50) / 10).alias("tmag"),
        F.when(F.col("l_linestatus") == "F", "SML").otherwise("PRI").alias("aperture"),
        F.col("l_linenumber").cast("int").alias("peak_rank"),
        period.alias("period_d"), t0.alias("t0_bjd"),
        (3 + F.col("l_quantity").cast("int") % 28).cast("double").alias("duration_min"),
        (F.col("l_discount") + 0.01).alias("depth"), (F.col("l_extendedprice") / 5000).alias("depth_snr"),
        (F.col("l_extendedprice") / 4000).alias("sde"), (F.col("l_extendedprice") / 100000).alias("log_power"),
        (200 + F.col("l_partkey") % 900).alias("n_cad_kept"), F.lit(27.0).alias("baseline_d"),
        F.lit("ok").alias("status"), F.lit("run1").alias("bls_run_id"),
        F.col("l_orderkey").alias("injection_id"), F.col("l_partkey").alias("uid_a"), F.col("l_suppkey").alias("uid_b"))


def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected truth per id, on a 5 x 5 period-radius grid."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    radius = 0.5 + (k % 40) / 4
    return o.select(
        k.alias("injection_id"), F.col("o_custkey").alias("tic"), (k % 8).cast("int").alias("shard_index"),
        (0.12 + (k % 1500) / 100).alias("truth_period_d"), (2457000 + (k % 50) / 10).alias("truth_t0_bjd"),
        (3 + k % 28).cast("double").alias("truth_duration_min"),
        (0.01 + (F.floor("o_totalprice") % 90) / 100).alias("model_depth"),
        (16 + (k % 50) / 10).alias("tmag"), radius.alias("radius_rearth"),
        F.floor((k % 1500) / 300).cast("bigint").alias("grid_period_bin"),
        F.floor((k % 40) / 8).cast("bigint").alias("grid_radius_bin"),
        (1 + k % 30).alias("n_good_in_transit"), F.col("o_orderpriority").alias("source_kind"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source catalog rows with three magnitudes, astrometry and a membership probability."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("source_id"), ((k * 37 % 3600) / 10).alias("ra"), ((k * 53 % 1800) / 10 - 90).alias("dec"),
        F.when(k % 11 == 0, F.lit(None)).otherwise((k % 29 - 1) / 10).cast("double").alias("parallax"),
        (0.8 + (k % 10) / 10).alias("ruwe"), (k % 17 == 0).alias("duplicated_source"),
        (15 + (k % 50) / 10).alias("phot_g_mean_mag"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(15.3 + (k % 50) / 10).cast("double").alias("phot_bp_mean_mag"),
        (14.8 + (k % 47) / 10).alias("phot_rp_mean_mag"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("pwd"), F.col("c_nationkey").alias("region"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector sightings per source and sector, possibly repeated."""
    li = table(spark, sf_dir, "lineitem")
    sector = (F.year("l_shipdate") * 12 + F.month("l_shipdate")) - F.lit(1994 * 12)
    return li.select(
        F.col("l_suppkey").alias("catalog_row"), F.col("l_suppkey").alias("source_id"), sector.cast("int").alias("sector"),
        (1 + F.col("l_linenumber") % 4).cast("int").alias("camera"), (1 + F.col("l_partkey") % 4).cast("int").alias("ccd"),
        (F.col("l_partkey") % 2100 + 0.5).alias("colpix"), (F.col("l_quantity") * 41 % 2050 + 0.25).alias("rowpix"))


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only label changes; some have no timestamp."""
    c = table(spark, sf_dir, "conversations")
    stamp = F.when(F.col("turn") % 5 != 4, F.expr("timestampadd(MINUTE, cast(turn * 7 % 5 as int), TIMESTAMP_NTZ'2024-03-01 00:00:00')"))
    return c.select(
        F.col("conv_id").alias("row_id"), F.col("turn").alias("seq"), stamp.alias("updated_utc"),
        F.when(F.col("role") == "user", "planet_like").when(F.col("role") == "assistant", "uncertain")
         .otherwise("skip").alias("label"),
        F.when(F.col("conv_id") % 4 == 0, F.lit("p/2")).when(F.col("conv_id") % 4 == 1, F.lit("possible harmonic"))
         .when(F.col("conv_id") % 4 == 2, F.lit("2.5 p maybe")).otherwise(F.lit("")).alias("notes"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review queue with ephemerides, strata and scores."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("review_id"), (k % 700).alias("tic"), F.lit(1).alias("sector"),
        (0.12 + (k * 7 % 1500) / 100).alias("period_d"), (2457000 + (k % 70) / 10).alias("t0_bjd"),
        (3 + k % 28).cast("double").alias("duration_min"), F.col("source").alias("source_bucket"),
        F.when(F.col("lang") == "en", "real").otherwise("injected").alias("source_kind"),
        F.col("lang").alias("stratum"), (F.col("n_chars") / 100).alias("sde_max"),
        ((k * 13) % 101 / 10.0).alias("depth_snr"), (16 + (k % 50) / 10).alias("tmag"),
        F.when(k % 3 == 0, "SML").when(k % 3 == 1, "SML,PRI").otherwise("PRI").alias("apertures_agree"))


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One human label per reviewed row."""
    l = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    label = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.when(k % 3 == 0, "planet_like").otherwise("eclipsing_binary_or_pceb"))
             .when(F.col("quality") == 1, "wide_transit_like").when(F.col("toxic") == 1, "skip")
             .when(k % 2 == 0, "stellar_variability").otherwise("uncertain"))
    return l.select(k.alias("review_id"), label.alias("label"), (k % 2 == 0).alias("second_pass"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-class probabilities per candidate from the first four vector elements."""
    e = table(spark, sf_dir, "embeddings")
    x = [F.exp(F.col("embedding")[i].cast("double")) for i in range(4)]
    z = x[0] + x[1] + x[2] + x[3]
    names = ("planet", "eb", "variable", "other")
    k = F.col("vec_id")
    return e.select(
        k.alias("review_id"), (k % 211).alias("tic"), (1 + k % 5).cast("int").alias("rep_peak_rank"),
        (k * 31 % 97 / 4.0).alias("sde_max"), (16 + (k % 40) / 10).alias("tmag"),
        (0.12 + (k * 11 % 1300) / 100).alias("period_d"), (3 + k % 28).cast("double").alias("duration_min"),
        (1 + k % 3).cast("int").alias("sector"),
        *[(x[i] / z).alias(f"p_{n}") for i, n in enumerate(names)], (F.col("label") % 4).cast("int").alias("truth"),
        ((F.col("label") + k) % 5).cast("int").alias("fold"))
