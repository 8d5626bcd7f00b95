"""Catalog building, identifier bridges, sky coverage and detector summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumensift.functions import consts as K, exprs as E
from lumensift.operators.vet import first_by


def master_catalog(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """High-confidence and quality flags, magnitude, and the placeholders filled by later joins."""
    return df.withColumns({
        "is_highconf": F.coalesce(F.col("pwd") > threshold, F.lit(False)),
        "is_quality_ok": E.astrometric_quality("ruwe", "duplicated_source", "parallax", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag"),
        "tmag": E.broadband_magnitude("phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag"),
        "tic_id": F.lit(-1).cast("bigint"), "tic_match_status": F.lit("unresolved"), "observations_json": F.lit("[]")})


def manifest(df: DataFrame, version: str) -> DataFrame:
    return df.agg(F.lit(version).alias("build_version"), F.count(F.lit(1)).alias("n_rows"), F.count_if("is_highconf").alias("n_highconf"),
                  F.count_if("is_quality_ok").alias("n_quality_ok"), F.count_if(F.col("is_highconf") & F.col("is_quality_ok")).alias("n_both"))


def sector_orbits(spark: SparkSession, max_sector: int) -> DataFrame:
    """(sector, orbit) dimension: two orbits per sector with listed exceptions, numbered cumulatively."""
    extra = F.lit(0)
    for s, n in K.ORBITS_PER_SECTOR_EXCEPTIONS.items():
        extra = extra + F.when(F.col("sector") > s, n - K.ORBITS_PER_SECTOR).otherwise(0)
    n = F.lit(K.ORBITS_PER_SECTOR)
    for s, k in K.ORBITS_PER_SECTOR_EXCEPTIONS.items():
        n = F.when(F.col("sector") == s, k).otherwise(n)
    first = F.lit(K.FIRST_ORBIT) + (F.col("sector") - 1) * K.ORBITS_PER_SECTOR + extra
    d = spark.range(1, max_sector + 1).select(F.col("id").cast("int").alias("sector"))
    return d.select("sector", F.explode(F.sequence(first, first + n - 1)).alias("orbit"))


def expand_orbits(obs: DataFrame) -> DataFrame:
    """Sector rows times their orbits, computed per row (no join); unchanged when orbits exist."""
    if "orbit" in obs.columns:
        return obs
    extra, n = F.lit(0), F.lit(K.ORBITS_PER_SECTOR)
    for s, k in K.ORBITS_PER_SECTOR_EXCEPTIONS.items():
        extra = extra + F.when(F.col("sector") > s, k - K.ORBITS_PER_SECTOR).otherwise(0)
        n = F.when(F.col("sector") == s, k).otherwise(n)
    first = F.lit(K.FIRST_ORBIT) + (F.col("sector") - 1) * K.ORBITS_PER_SECTOR + extra
    return obs.withColumn("orbit", F.explode(F.sequence(first, first + n - 1)))


def coverage_payload(obs: DataFrame) -> DataFrame:
    """Per catalog row: counts, extremes and the ordered JSON list of its sightings.

    The JSON list is one cell by contract, so its length is that row's number of sightings.
    """
    item = F.struct("sector", "orbit", "camera", "ccd", F.round("colpix", 3).alias("colpix"), F.round("rowpix", 3).alias("rowpix"), "edge_warn")
    # the list is there anyway, so distinct values are counted in it: a distinct aggregate would copy every row twice more
    distinct = lambda c: F.size(F.array_distinct(F.filter(F.transform(F.collect_list(item), lambda x: x[c]), lambda v: v.isNotNull()))).cast("bigint")
    return obs.groupBy("catalog_row").agg(
        F.count(F.lit(1)).alias("n_observations"), distinct("sector").alias("n_sectors"), distinct("orbit").alias("n_orbits"),
        F.min("sector").alias("sector_min"), F.max("sector").alias("sector_max"), F.min("orbit").alias("orbit_min"), F.max("orbit").alias("orbit_max"),
        F.to_json(F.array_sort(F.collect_list(item))).alias("observations_json"))


def attach_coverage(catalog: DataFrame, payload: DataFrame) -> DataFrame:
    """Left join with defaults: false, 0, -1 and an empty list."""
    d = catalog.drop("observations_json").join(payload.withColumnRenamed("catalog_row", "source_id"), "source_id", "left")
    fill = {"n_observations": 0, "n_sectors": 0, "n_orbits": 0, "sector_min": -1, "sector_max": -1, "orbit_min": -1, "orbit_max": -1}
    return d.withColumns({"has_coverage": F.col("n_observations").isNotNull(), **{c: F.coalesce(c, F.lit(v)) for c, v in fill.items()},
                          "observations_json": F.coalesce("observations_json", F.lit("[]"))})


def export_table(catalog: DataFrame, obs: DataFrame, preferred: Sequence[str] = ("tic_id", "is_highconf", "tmag", "ra", "dec")) -> DataFrame:
    """Sightings with the preferred catalog columns that exist."""
    keep = [c for c in preferred if c in catalog.columns]
    return obs.join(catalog.select("source_id", *keep), "source_id")


def detector_summary(export: DataFrame) -> DataFrame:
    tic, high = F.col("tic_id") > 0, F.col("is_highconf")
    return export.groupBy("orbit", "sector", "camera", "ccd").agg(
        F.count(F.lit(1)).alias("n_targets_all"), F.count_if(tic).alias("n_targets_unique_tic"),
        F.count_if(high).alias("n_targets_highconf"), F.count_if(tic & high).alias("n_targets_highconf_unique_tic"))


def sector_summary(export: DataFrame) -> DataFrame:
    """Distinct sources under four conditions. Sources are reduced to one row per sector first, so the
    distinct counts are plain sums instead of a multi-distinct expansion."""
    tic, high = F.col("tic_id") > 0, F.col("is_highconf")
    per = export.groupBy("sector", "source_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(tic).alias("t"), F.bool_or(high).alias("h"), F.bool_or(tic & high).alias("th"))
    s = per.groupBy("sector").agg(F.count(F.lit(1)).alias("n_unique_targets_all"), F.count_if("t").alias("n_unique_targets_unique_tic"),
                                  F.count_if("h").alias("n_unique_targets_highconf"), F.count_if("th").alias("n_unique_targets_highconf_unique_tic"),
                                  F.sum("rows").alias("n_detector_target_rows"))
    det = export.select("sector", "orbit", "camera", "ccd").distinct().groupBy("sector").agg(F.count(F.lit(1)).alias("n_orbit_detector_footprints"))
    return s.join(det, "sector")


def observed_counts(obs: DataFrame, cutoff: int, mode: str = "sectors") -> DataFrame:
    """Per source: observed (up to the cutoff) and all rows or distinct sectors."""
    d = obs.select("source_id", "sector").distinct() if mode == "sectors" else obs
    return d.groupBy("source_id").agg(F.count_if(F.col("sector") <= cutoff).alias("observed"), F.count(F.lit(1)).alias("total"))


def coverage_summary(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    d = catalog.select("source_id").join(counts, "source_id", "left")
    pos = F.when(F.col("observed") > 0, F.col("observed"))
    return d.agg(F.count(F.lit(1)).alias("n_targets"), F.count(pos).alias("n_nonzero"), F.median(pos).alias("median_positive"), F.max("observed").alias("max_observed"))


def probability_bins(pwd: Column) -> Column:
    """Four bins; the first is closed below and open above, the last closed on both sides."""
    return (F.when((pwd >= 0.0) & (pwd < 0.25), "0.00-0.25").when((pwd >= 0.25) & (pwd < 0.5), "0.25-0.50")
            .when((pwd >= 0.5) & (pwd <= 0.75), "0.50-0.75").when((pwd > 0.75) & (pwd <= 1.0), "0.75-1.00"))


def probability_bin_summary(catalog: DataFrame) -> DataFrame:
    dist = F.when(F.col("parallax") > 0, 1000.0 / F.nullif("parallax", F.lit(0.0)))
    d = catalog.withColumns({"pwd_bin": probability_bins(F.col("pwd")), "distance_pc": dist}).where("pwd_bin IS NOT NULL")
    return d.groupBy("pwd_bin").agg(F.count(F.lit(1)).alias("n"), F.percentile("distance_pc", 0.5).alias("median_pc"), F.percentile("distance_pc", 0.95).alias("p95_pc"))


def merge_status(catalog: DataFrame, summary: DataFrame) -> DataFrame:
    """Match status and id by source; unknown text becomes 'unknown', ids only where unique."""
    valid = ("no_dr2_match", "dr2_no_tic", "unique_tic", "multiple_tic")
    s = summary.select("source_id", F.col("status").alias("_s"), F.col("tic").alias("_t"))
    d = catalog.drop("tic_match_status", "tic_id").join(s, "source_id", "left")
    status = F.when(F.col("_s").isNull(), "unresolved").when(F.col("_s").isin(*valid), F.col("_s")).otherwise("unknown")
    return d.withColumns({"tic_match_status": status, "tic_id": F.when((status == "unique_tic") & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.lit(-1).cast("bigint"))}).drop("_s", "_t")


def status_counters(catalog: DataFrame) -> DataFrame:
    st = F.col("tic_match_status")
    names = ("no_dr2_match", "dr2_no_tic", "unique_tic", "multiple_tic", "unknown", "unresolved")
    return catalog.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(st == n).alias(f"n_{n}") for n in names], F.count_if(F.col("tic_id") > 0).alias("n_with_tic"))


def bridge_match(ids: DataFrame, hop1: DataFrame, hop2: DataFrame) -> DataFrame:
    """Two-hop identifier bridge: source -> older release (0..n) -> target (0..n), with status and id lists."""
    j = ids.select("source_id").join(hop1, "source_id", "left").join(hop2, "dr2_id", "left")
    g = j.groupBy("source_id").agg(F.array_sort(F.collect_set("dr2_id")).alias("dr2_ids"), F.array_sort(F.collect_set("tic")).alias("tics"))
    n_d, n_t = F.size("dr2_ids"), F.size("tics")
    status = F.when(n_d == 0, "no_dr2_match").when(n_t == 0, "dr2_no_tic").when(n_t == 1, "unique_tic").otherwise("multiple_tic")
    return g.select("source_id", n_d.alias("n_dr2"), n_t.alias("n_tic"), status.alias("status"), F.when(n_t == 1, F.col("tics")[0]).alias("tic"),
                    F.to_json("dr2_ids").alias("dr2_ids_json"), F.to_json("tics").alias("tic_ids_json"))


def tile_overlay(targets: DataFrame, n_x: int, n_y: int, size: int, overlap: int, x_offset: int = 44) -> DataFrame:
    """Targets to every overlapping tile that contains them.

    Candidate tiles come from the coordinates by division (one or two per axis), then the inclusive bounds decide.
    """
    stride = size - 2 * overlap
    axis = lambda v, off, n: F.filter(F.sequence(F.floor((F.col(v) - off - size + 1) / stride), F.floor((F.col(v) - off) / stride)),
                                      lambda i: (i >= 0) & (i < n))
    d = targets.withColumn("grid_x", F.explode(axis("colpix", x_offset, n_x))).withColumn("grid_y", F.explode(axis("rowpix", 0, n_y)))
    b = E.tile_bounds("grid_x", "grid_y", size, overlap, x_offset)
    return d.where(F.col("colpix").between(b["x_min"], b["x_max"]) & F.col("rowpix").between(b["y_min"], b["y_max"]))


def source_targets(catalog: DataFrame, sources: DataFrame, tmag_max: float, n: int) -> DataFrame:
    """Catalog rows named by a source list, bright enough, the first ``n`` by magnitude."""
    return catalog.join(sources.select("source_id").distinct(), "source_id", "left_semi").where(F.col("tmag") <= tmag_max).orderBy("tmag", "source_id").limit(n)


def pointing_join(targets: DataFrame, pointings: Sequence[tuple], half_width_deg: float) -> DataFrame:
    """Targets through a list of (sector, ra, dec) pointings: separation test per pointing.

    The pointing list is a fixed instrument table of about a hundred rows, carried as an array literal.
    """
    arr = F.array(*[F.struct(F.lit(int(s)).alias("sector"), F.lit(float(a)).alias("pra"), F.lit(float(b)).alias("pdec")) for s, a, b in pointings])
    d = targets.withColumn("p", F.explode(arr))
    ra, dec, pa, pd_ = F.radians("ra"), F.radians("dec"), F.radians("p.pra"), F.radians("p.pdec")
    cosd = F.sin(dec) * F.sin(pd_) + F.cos(dec) * F.cos(pd_) * F.cos(ra - pa)
    return d.withColumn("sep_deg", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosd))))).where(F.col("sep_deg") <= half_width_deg) \
        .withColumn("sector", F.col("p.sector")).drop("p")


def enrich_stars(queue: DataFrame, stars: DataFrame, atmospheres: Sequence[str]) -> DataFrame:
    """First catalog row per target; the first valid atmosphere in priority order; radius from gravity, density, defaults when none."""
    s = first_by(stars, ["tic"], F.col("source_id"))
    fits = [F.when((F.col(f"{a}_mass") > 0) & (F.col(f"{a}_logg") > 0),
                   F.struct(F.lit(a).alias("atmosphere"), F.col(f"{a}_mass").cast("double").alias("mass"), F.col(f"{a}_logg").cast("double").alias("logg"))) for a in atmospheres]
    s = s.select("tic", F.coalesce(*fits).alias("f"))
    d = queue.join(s, "tic", "left")
    # sun: GM in SI, g in cgs
    radius = F.sqrt(F.col("f.mass") * K.GM_SUN_SI / (F.pow(F.lit(10.0), F.col("f.logg")) / 100.0)) / K.R_SUN_M
    has = F.col("f").isNotNull()
    return d.withColumns({"star_source": F.when(has, F.col("f.atmosphere")).otherwise("default"), "star_mass": F.coalesce("f.mass", F.lit(0.6)),
                          "star_radius": F.when(has, radius).otherwise(F.lit(0.013))}).drop("f") \
        .withColumn("star_density", F.col("star_mass") / F.pow("star_radius", F.lit(3.0)))


def completeness(expected: DataFrame, found: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Expected against found files by several groupings at once; missing split by edge flag, empty and extra counted."""
    keys = list(keys)
    j = expected.withColumn("_e", F.lit(True)).join(found.withColumn("_f", F.lit(True)), keys, "full_outer")
    e, f, edge = F.col("_e").isNotNull(), F.col("_f").isNotNull(), F.coalesce("edge_warn", F.lit(False))
    dims = sorted({c for s in sets for c in s})
    return j.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        F.count_if(e).alias("n_expected"), F.count_if(e & f).alias("n_found"), F.count_if(e & ~f & edge).alias("n_missing_edge"),
        F.count_if(e & ~f & ~edge).alias("n_missing"), F.count_if(f & (F.col("length") == 0)).alias("n_empty"), F.count_if(f & ~e).alias("n_extra"))


def drop_unlisted(df: DataFrame, authority: DataFrame, keys: Sequence[str], max_drop: int) -> DataFrame:
    """Keep rows whose key the authority lists; targets losing more than ``max_drop`` rows are flagged and kept out."""
    keys = list(keys)
    j = df.join(authority.select(*keys).distinct().withColumn("_ok", F.lit(True)), keys, "left")
    lost = j.groupBy("tic").agg(F.count_if(F.col("_ok").isNull()).alias("n_dropped"))
    return j.where("_ok").drop("_ok").join(lost, "tic").withColumn("drop_ok", F.col("n_dropped") <= max_drop)
