"""Scalar column expressions: ephemerides, geometry, status, text and period rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
import math

from pyspark.sql import Column, functions as F

from lumensift.functions import consts as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# --- phase and epoch -------------------------------------------------------

def phase_days(t, period, t0) -> Column:
    """Signed time from the nearest event centre, in [-P/2, P/2)."""
    t, p, t0 = _c(t), _c(period), _c(t0)
    return F.pmod(t - t0 + p / 2, p) - p / 2


def orbital_phase(t, period, t0) -> Column:
    """Signed phase in cycles, in [-0.5, 0.5)."""
    return phase_days(t, period, t0) / _c(period)


def phase_minutes(t, period, t0) -> Column:
    return phase_days(t, period, t0) * K.MIN_PER_DAY


def event_number(t, period, t0) -> Column:
    """Nearest event index (half-even rounding)."""
    return F.rint((_c(t) - _c(t0)) / _c(period)).cast("bigint")


def event_times(lo, hi, period, t0) -> Column:
    """Array of event centres inside [lo, hi]."""
    first = F.ceil((_c(lo) - _c(t0)) / _c(period))
    last = F.floor((_c(hi) - _c(t0)) / _c(period))
    grid = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(grid, lambda k: _c(t0) + k * _c(period))


def circular_distance(phase, center) -> Column:
    return F.abs(F.pmod(_c(phase) - _c(center) + 0.5, F.lit(1.0)) - 0.5)


def epoch_offset_min(t0a, t0b, period) -> Column:
    """Smallest |t0a - t0b - kP| in minutes."""
    return F.abs(phase_days(t0a, period, t0b)) * K.MIN_PER_DAY


def in_window(t, period, t0, duration_min) -> Column:
    """Inside a periodic box; false for invalid periods or durations."""
    ok = (_c(period) > 0) & (_c(duration_min) > 0)
    inside = F.abs(phase_days(t, period, t0)) <= _c(duration_min) / 2 / K.MIN_PER_DAY
    return F.coalesce(F.when(ok, inside), F.lit(False))


def in_wide_window(t, period, t0, duration_min, factor: float = 3.0, min_width_min: float = 20.0) -> Column:
    """Inside the widened window: max(min width, factor x duration)."""
    wide = F.greatest(F.lit(min_width_min), factor * _c(duration_min))
    ok = (_c(period) > 0) & (_c(duration_min) > 0)
    inside = F.abs(phase_days(t, period, t0)) <= wide / 2 / K.MIN_PER_DAY
    return F.coalesce(F.when(ok, inside), F.lit(False))


def absolute_time(t, median_time) -> Column:
    """Relative day numbers gain the time zero; absolute ones stay."""
    return F.when(_c(median_time) < 1e5, _c(t) + K.TIME_ZERO).otherwise(_c(t))


def relative_time(t, median_time) -> Column:
    return F.when(_c(median_time) > 1e5, _c(t) - K.TIME_ZERO).otherwise(_c(t))


# --- fold windows ----------------------------------------------------------

def fold_window_min(duration_min) -> Column:
    d = _c(duration_min)
    return F.when(d > 0, F.least(F.greatest(F.lit(18.0), 4.0 * d), F.lit(60.0))).otherwise(F.lit(45.0))


def fold_bin_count(window_min, duration_min) -> Column:
    d = _c(duration_min)
    width = F.when(d > 0, F.greatest(F.lit(1.0), F.least(F.lit(3.0), d / 3.0))).otherwise(F.lit(2.0))
    n = F.ceil(2.0 * _c(window_min) / width)
    return F.least(F.greatest(n, F.lit(18).cast("bigint")), F.lit(72).cast("bigint"))


def fold_window_phase(period, duration_min) -> Column:
    w = fold_window_min(duration_min) / (_c(period) * K.MIN_PER_DAY)
    return F.when(_c(period) > 0, F.least(F.greatest(w, F.lit(0.0015)), F.lit(0.25))).otherwise(F.lit(0.03))


# --- periods and harmonics -------------------------------------------------

def _rel(ratio: Column, factor: float) -> Column:
    return F.abs(ratio - factor) / factor


def nearest_harmonic(ratio, factors: Sequence[float] = K.HARMONIC_FACTORS) -> Column:
    """Struct (rel_err, factor) of the closest factor; earlier factors win ties."""
    r = _c(ratio)
    options = [F.struct(_rel(r, f).alias("rel_err"), F.lit(i).alias("pos"), F.lit(float(f)).alias("factor"))
               for i, f in enumerate(factors)]
    return F.when(r > 0, F.array_min(F.array(*options)))


def nearest_supported_factor(value, tol: float = K.PERIOD_TOL) -> Column:
    best = nearest_harmonic(value)
    return F.when(best["rel_err"] <= tol, best["factor"])


def harmonic_name(factor, atol: float = 1e-8) -> Column:
    """Name of an exact harmonic factor, '' for anything else."""
    f = _c(factor)
    chain = reduce(lambda acc, nf: acc.when(F.abs(f - nf[1]) <= atol, nf[0]),
                   zip(K.HARMONIC_NAMES[1:], K.HARMONIC_FACTORS[1:]),
                   F.when(F.abs(f - K.HARMONIC_FACTORS[0]) <= atol, K.HARMONIC_NAMES[0]))
    return chain.otherwise("")


def period_relation(reference, comparison, tol: float = K.RELATION_TOL,
                    factors: Sequence[float] = (0.25, 1.0 / 3.0, 0.5, 2.0, 3.0, 4.0)) -> Column:
    """exact, harmonic, unrelated or missing."""
    ratio = _c(comparison) / _c(reference)
    valid = (_c(reference) > 0) & (_c(comparison) > 0)
    errs = F.array_min(F.array(*[_rel(ratio, f) for f in factors]))
    return (F.when(~F.coalesce(valid, F.lit(False)), "missing")
            .when(F.abs(ratio - 1) <= tol, "exact").when(errs <= tol, "harmonic").otherwise("unrelated"))


def is_harmonic(period_a, period_b, tol: float = 0.02) -> Column:
    """Ratio within ``tol`` of 1/2, 1/3, 2 or 3."""
    ratio = _c(period_a) / _c(period_b)
    hit = reduce(lambda a, b: a | b, [_rel(ratio, f) <= tol for f in (0.5, 1.0 / 3.0, 2.0, 3.0)])
    return F.coalesce(F.when((_c(period_a) > 0) & (_c(period_b) > 0), hit), F.lit(False))


def cadence_alias(period, cadence_d: float = 200.0 / 86400.0, tol: float = 0.02) -> Column:
    n = _c(period) / cadence_d
    return F.abs(n - F.rint(n)) <= tol


def window_overlap(period, t0, duration, tperiod, tt0, tduration) -> Column:
    """Struct (delta_min, overlap_min, fraction) of two windows folded at the shorter period."""
    d = F.when(_c(duration) > 0, _c(duration)).otherwise(F.when(_c(tduration) > 0, _c(tduration)))
    e = F.when(_c(tduration) > 0, _c(tduration)).otherwise(d)
    ok = (_c(period) > 0) & (_c(tperiod) > 0)
    delta = F.when(ok, phase_minutes(t0, F.least(_c(period), _c(tperiod)), tt0))
    overlap = F.greatest(F.lit(0.0), (d + e) / 2 - F.abs(delta))
    overlap = F.when(delta.isNotNull() & d.isNotNull(), overlap)
    return F.struct(delta.alias("delta_min"), overlap.alias("overlap_min"),
                    F.least(F.lit(1.0), overlap / F.least(d, e)).alias("fraction"))


# --- physics ---------------------------------------------------------------

def roche_period(rho_g_cm3: float = K.RHO_MIN_G_CM3) -> float:
    return 12.6 / 24.0 * math.sqrt(K.RHO_JUP_G_CM3 / rho_g_cm3)


def duration_envelope_min(period) -> Column:
    """Longest chord of the largest allowed companion, plus the exposure smear."""
    v = F.pow(F.lit(2 * math.pi * K.HOST_MASS_MSUN * K.GM_SUN_SI) / (_c(period) * K.SEC_PER_DAY), F.lit(1.0 / 3.0))
    reach = K.HOST_RADIUS_RSUN * K.R_SUN_M + K.COMPANION_MAX_RJUP * K.R_JUP_M
    return F.lit(2.0 * reach) / v / 60.0 + K.CADENCE_SMEAR_MIN


def semi_major_over_radius(period) -> Column:
    """a/R from Kepler's third law at the host density."""
    k = K.G_SI * K.STAR_DENSITY_G_CM3 * 1000.0 / (3.0 * math.pi)
    return F.pow(F.lit(k) * F.pow(_c(period) * K.SEC_PER_DAY, F.lit(2.0)), F.lit(1.0 / 3.0))


def chord_duration_min(period, radius, impact, a_over_r) -> Column:
    chord = F.sqrt(F.greatest(F.pow(1.0 + _c(radius), F.lit(2.0)) - F.pow(_c(impact), F.lit(2.0)), F.lit(1e-6)))
    minutes = _c(period) / math.pi * chord / F.greatest(_c(a_over_r), F.lit(1e-6)) * K.MIN_PER_DAY
    cap = F.greatest(F.lit(2.0), F.least(F.lit(180.0), K.MAX_DUTY_CYCLE * _c(period) * K.MIN_PER_DAY))
    return F.least(F.greatest(minutes, F.lit(2.0)), cap)


def circle_overlap(radius, impact) -> Column:
    """Share of the unit disk hidden by a disk of ``radius`` at centre distance ``impact``."""
    r, d = _c(radius), F.abs(_c(impact))
    clamp = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    # guarded divisors keep the untaken branch defined under ANSI arithmetic
    sd = F.greatest(d, F.lit(1e-12))
    sr = F.greatest(r, F.lit(1e-12))
    a = F.acos(clamp((d * d + 1.0 - r * r) / (2.0 * sd)))
    b = F.acos(clamp((d * d + r * r - 1.0) / (2.0 * sd * sr)))
    kite = F.sqrt(F.greatest((-d + 1.0 + r) * (d + 1.0 - r) * (d - 1.0 + r) * (d + 1.0 + r), F.lit(0.0)))
    lens = (a + r * r * b - 0.5 * kite) / math.pi
    return (F.when((r <= 0) | (d >= 1.0 + r), F.lit(0.0))
            .when(d <= F.abs(1.0 - r), F.least(r * r, F.lit(1.0)))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lens))))


def impact_for_depth(radius, depth, steps: int = 64) -> Column:
    """Impact whose overlap equals ``depth``, by interval halving inside one expression."""
    r, target = _c(radius), _c(depth)
    central = circle_overlap(r, F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("lo"), (1.0 + r).cast("double").alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        deep = circle_overlap(r, mid) > target
        return F.struct(F.when(deep, mid).otherwise(acc["lo"]).alias("lo"),
                        F.when(deep, acc["hi"]).otherwise(mid).alias("hi"))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(target >= central, F.lit(0.0)).when(target <= 0, 1.0 + r).otherwise(solved)


def signal_family(period, radius_rearth) -> Column:
    p, r = _c(period), _c(radius_rearth)
    return (F.when(p < 0.25, "wd_roche_edge").when(p > 2.5, "wd_long_period")
            .when(r < 0.35, "wd_small_body").when(r < 1.2, "wd_earth_size").otherwise("wd_giant_or_bd"))


def log_edges(lo: float, hi: float, bins: int) -> list[float]:
    if lo <= 0 or hi <= lo or bins <= 0:
        raise ValueError(f"invalid log range {lo}..{hi} / {bins}")
    a, b = math.log(lo), math.log(hi)
    return [math.exp(a + (b - a) * i / bins) for i in range(bins + 1)]


def linear_edges(lo: float, hi: float, bins: int) -> list[float]:
    if hi <= lo or bins <= 0:
        raise ValueError(f"invalid range {lo}..{hi} / {bins}")
    return [lo + (hi - lo) * i / bins for i in range(bins + 1)]


def bin_index(value, edges: Sequence[float], closed: str = "left", include_lowest: bool = False) -> Column:
    """0-based bin by ascending edges; ``closed`` names the closed side; NULL outside."""
    v = _c(value)
    chain = None
    for i in range(len(edges) - 1):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if closed == "left":
            cond = (v >= lo) & (v < hi)
        else:
            cond = (v > lo) & (v <= hi)
            if include_lowest and i == 0:
                cond = (v >= lo) & (v <= hi)
        chain = F.when(cond, F.lit(i)) if chain is None else chain.when(cond, F.lit(i))
    return chain.cast("bigint")


def tmag_bin(tmag) -> Column:
    t = _c(tmag)
    return (F.when(t < K.TMAG_EDGES[0], K.TMAG_LABELS[0]).when(t < K.TMAG_EDGES[1], K.TMAG_LABELS[1])
            .when(t < K.TMAG_EDGES[2], K.TMAG_LABELS[2]).when(t.isNotNull(), K.TMAG_LABELS[3]))


def broadband_magnitude(g, bp, rp) -> Column:
    """Cubic colour transform with a constant offset where the colour is missing."""
    c = _c(bp) - _c(rp)
    t = _c(g) - 0.00522555 * F.pow(c, F.lit(3.0)) + 0.0891337 * F.pow(c, F.lit(2.0)) - 0.633923 * c + 0.0324473
    return F.when(t.isNull() | F.isnan(t), _c(g) - 0.430).otherwise(t)


def count_rate(tmag) -> Column:
    return 1.5e4 * F.pow(F.lit(10.0), (10.0 - _c(tmag)) / 2.5)


def astrometric_quality(ruwe, duplicated, parallax, g, bp, rp) -> Column:
    fin = lambda x: _c(x).isNotNull() & ~F.isnan(_c(x))
    ok = (fin(ruwe) & (_c(ruwe) <= 1.4) & ~_c(duplicated) & fin(parallax) & (_c(parallax) > 0)
          & fin(g) & fin(bp) & fin(rp))
    return F.coalesce(ok, F.lit(False))


def galactic(ra_deg, dec_deg) -> tuple[Column, Column]:
    """Galactic longitude (wrapped at 180, negated) and latitude, from the published rotation."""
    # fixed rotation matrix, ICRS to galactic
    m = ((-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
         (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
         (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669))
    ra, dec = F.radians(_c(ra_deg)), F.radians(_c(dec_deg))
    v = (F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec))
    x, y, z = (row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m)
    lon = F.degrees(F.atan2(y, x))
    return -lon, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def edge_warn(col, row) -> Column:
    return ((_c(col) <= K.X_MIN + K.EDGE_PIXELS) | (_c(col) >= K.X_MAX - K.EDGE_PIXELS)
            | (_c(row) <= K.EDGE_PIXELS) | (_c(row) >= K.Y_MAX - K.EDGE_PIXELS))


def tile_bounds(grid_x, grid_y, size: int, overlap: int, x_offset: int = 44) -> dict[str, Column]:
    stride = size - 2 * overlap
    x0 = _c(grid_x) * stride + x_offset
    y0 = _c(grid_y) * stride
    return {"x_min": x0, "x_max": x0 + size - 1, "y_min": y0, "y_max": y0 + size - 1}


def propagated_error(err, source_rate, model, cadence_s: float = 200.0) -> Column:
    """Photon noise rescaled from the unmodified to the dimmed source."""
    shot = _c(source_rate) / cadence_s
    return F.sqrt(F.greatest(F.pow(_c(err), F.lit(2.0)) - shot, F.lit(0.0)) + _c(model) * shot)


def ulp_equal(a, b, max_ulps: int = 4) -> Column:
    """Equal within a few units in the last place; missing equals missing."""
    a, b = _c(a), _c(b)
    both_missing = (a.isNull() | F.isnan(a)) & (b.isNull() | F.isnan(b))
    close = F.abs(a - b) <= max_ulps * 2.220446049250313e-16 * F.greatest(F.abs(a), F.abs(b))
    return both_missing | F.coalesce(a == b, F.lit(False)) | F.coalesce(close, F.lit(False))


# --- status ----------------------------------------------------------------

def _status(value: Column, good: Column, so_so: Column) -> Column:
    missing = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(missing, "fail").when(good, "pass").when(so_so, "review").otherwise("fail")


def status_max(value, pass_limit: float, review_limit: float) -> Column:
    v = _c(value).cast("double")
    return _status(v, v <= pass_limit, v <= review_limit)


def status_min(value, pass_limit: float, review_limit: float) -> Column:
    v = _c(value).cast("double")
    return _status(v, v >= pass_limit, v >= review_limit)


def status_interval(value, pass_low: float, pass_high: float, review_low: float, review_high: float) -> Column:
    v = _c(value).cast("double")
    return _status(v, v.between(pass_low, pass_high), v.between(review_low, review_high))


def worst_status(*statuses) -> Column:
    """fail beats review beats pass; a missing status is a fail."""
    code = lambda s: F.when(_c(s) == "pass", 0).when(_c(s) == "review", 1).otherwise(2)
    codes = [code(s) for s in statuses]
    top = F.greatest(*codes) if len(codes) > 1 else codes[0]
    return F.when(top == 0, "pass").when(top == 1, "review").otherwise("fail")


# --- text, keys and labels -------------------------------------------------

def number_text(value) -> Column:
    """Text of a number with 15 significant digits, as label logs write it; '' when missing."""
    v = _c(value).cast("double")
    parts = F.regexp_extract_all(F.format_string("%.14e", F.abs(v)), F.lit("[0-9]+"), F.lit(0))
    digits = F.concat(F.element_at(parts, 1), F.element_at(parts, 2))
    power = F.element_at(parts, 3).cast("int") * F.when(F.abs(v) < 1, -1).otherwise(1)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "0+$", ""), "[.]$", "")
    plain = F.when(power >= 0, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(15)))) \
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    science = F.concat(bare(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 14))), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    text = F.when(v == 0, "0").when((power < -4) | (power >= 15), F.when(F.abs(power) > 99, F.regexp_replace(science, "e([+-]).*$", F.concat(F.lit("e$1"), F.abs(power).cast("string")))).otherwise(science)).otherwise(bare(plain))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "").otherwise(F.concat(F.when(v < 0, "-").otherwise(""), text))


def id_text(value) -> Column:
    """As ``number_text``, with numbers within 1e-9 of a whole one written as that."""
    v = _c(value).cast("double")
    whole = (F.abs(v - F.rint(v)) <= 1e-9) & (F.abs(v) < 1e18)
    return F.when(whole, F.rint(v).cast("bigint").cast("string")).otherwise(number_text(value))


def candidate_key(tic="tic", sector="sector", period="period_d", t0="t0_bjd", bucket="source_bucket") -> Column:
    return F.concat_ws("|", id_text(tic), id_text(sector), number_text(period), number_text(t0), F.trim(F.coalesce(_c(bucket), F.lit(""))))


def text_bool(value) -> Column:
    return F.coalesce(F.lower(F.trim(_c(value).cast("string"))).isin(*K.TRUE_TEXT), F.lit(False))


def blank_to_null(value) -> Column:
    return F.when(F.trim(_c(value)) != "", _c(value))


def label_target(label) -> Column:
    """Training target of a label; '' when excluded."""
    return F.when(_c(label).isin(*K.STRONG_LABELS, "uncertain"), _c(label)).otherwise("")


def effective_label(*columns) -> Column:
    """First non-empty label in the given order, '' when none."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def last_token_id(text) -> Column:
    """Numeric last token of a designation, NULL when it is not a number."""
    return F.element_at(F.split(F.trim(_c(text)), r"\s+"), -1).try_cast("bigint")


def note_refold(note) -> Column:
    """Struct (suspect, factor, reason) read from a reviewer note; half before double before a bare suspicion."""
    n = F.coalesce(_c(note), F.lit(""))
    found = F.struct(F.lit(False).alias("suspect"), F.lit(None).cast("double").alias("factor"), F.lit("").alias("reason"))
    for pattern, factor, reason in reversed(K.REFOLD_NOTES):
        found = F.when(n.rlike(pattern), F.struct(F.lit(True).alias("suspect"), F.lit(factor).cast("double").alias("factor"), F.lit(reason).alias("reason"))).otherwise(found)
    return found


def note_period_factor(note) -> Column:
    """Explicit P/n or nP notes as a factor; the named words come before numbers."""
    n = F.lower(F.trim(F.coalesce(_c(note), F.lit(""))))
    number = lambda p: F.nullif(F.regexp_extract(n, p, 1), F.lit("")).try_cast("double")
    over, times = number(K.NOTE_DIVISOR), number(K.NOTE_MULTIPLIER)
    numeric = F.when(over.isNotNull(), 1.0 / F.when(over > 0, over)).otherwise(F.when(times > 0, times))
    for pattern, factor in reversed(K.NOTE_WORDS.items()):
        numeric = F.when(n.rlike(pattern), F.lit(factor)).otherwise(numeric)
    return numeric


def button_factor(text) -> Column:
    """Struct (factor_text, status, factor) of a saved period button; unknown text gives NULLs."""
    t = F.coalesce(F.nullif(F.lower(F.trim(_c(text))), F.lit("")), F.lit("1"))
    open_ = t.isin("?", "unresolved")
    number = F.when(~open_, t.try_cast("double"))
    known = number.isin(0.25, 0.5, 1.0, 2.0, 4.0)
    name = (F.when(open_, "unresolved").when(number == 0.25, "0.25").when(number == 0.5, "0.5")
            .when(known, number.cast("bigint").cast("string")))
    status = F.when(open_, "unresolved").when(number == 1.0, "review_period").when(known, "refolded")
    return F.struct(name.alias("factor_text"), status.alias("status"), F.when(known, number).alias("factor"))


def first_ephemeris(*options: tuple[str, str, str, str]) -> Column:
    """First complete (period, t0, duration) among column triples, with its source name."""
    def one(p, t, d, source):
        ok = (_c(p) > 0) & _c(t).isNotNull() & ~F.isnan(_c(t)) & (_c(d) > 0)
        return F.when(ok, F.struct(_c(p).cast("double").alias("period_d"), _c(t).cast("double").alias("t0_bjd"),
                                   _c(d).cast("double").alias("duration_min"), F.lit(source).alias("source")))
    none = F.struct(F.lit(None).cast("double").alias("period_d"), F.lit(None).cast("double").alias("t0_bjd"),
                    F.lit(None).cast("double").alias("duration_min"), F.lit("invalid").alias("source"))
    return F.coalesce(*[one(*o) for o in options], none)


def derived_ephemerides(period, t0, secondary_t0=None) -> Column:
    """Array of the five folds a reviewer sees: as found, search, half, double, secondary."""
    p, t = _c(period).cast("double"), _c(t0).cast("double")
    sec = t + p / 2 if secondary_t0 is None else F.coalesce(_c(secondary_t0), t + p / 2)
    view = lambda name, pp, tt: F.struct(F.lit(name).alias("view"), pp.alias("period_d"), tt.alias("t0_bjd"))
    return F.array(view("model", p, t), view("search", p, t), view("half", p / 2, t),
                   view("double", p * 2, t), view("secondary", p, sec))


def class_index(target, classes: Sequence[str], include=None) -> Column:
    """0-based class position, -1 when excluded or unknown."""
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), _c(target)) - 1
    keep = F.lit(True) if include is None else _c(include)
    return F.when(keep, F.coalesce(pos, F.lit(-1).cast("bigint"))).otherwise(F.lit(-1).cast("bigint"))


# --- reference curves ------------------------------------------------------

def log_interp(x, anchors: Sequence[tuple[float, float]]) -> Column:
    """Log-log interpolation through anchor points, held flat outside."""
    v = F.log(_c(x))
    pts = [(math.log(a), math.log(b)) for a, b in anchors]
    chain = F.when(v <= pts[0][0], F.lit(pts[0][1]))
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        chain = chain.when(v <= x1, F.lit(y0) + (v - x0) * ((y1 - y0) / (x1 - x0)))
    return F.exp(chain.otherwise(F.lit(pts[-1][1])))


def fluid_roche_period_d(density_g_cm3, c: float = 2.44) -> Column:
    """sqrt(3 pi C^3 / G rho) in days."""
    return F.sqrt(F.lit(3 * math.pi * c**3 / K.G_SI) / (_c(density_g_cm3) * 1000.0)) / K.SEC_PER_DAY


def boundary_radius(intercept: float, slope_radius: float, slope_mag: float, tmag, probability: float) -> Column:
    """Radius at which a logistic in log10(radius) and magnitude reaches a probability."""
    logit = math.log(probability / (1 - probability))
    return F.pow(F.lit(10.0), (F.lit(logit - intercept) - slope_mag * _c(tmag)) / slope_radius)
