"""Fixed values. They must equal the published survey settings for right results."""

# time zero of relative day numbers
TIME_ZERO = 2457000.0
MAD_SIGMA = 1.4826
MIN_PER_DAY = 1440.0
SEC_PER_DAY = 86400.0

# periodic search
P_MIN_D = 0.12
P_MAX_CAP_D = 15.0
MAX_PERIOD_FRACTION = 0.45
SEARCH_DURATIONS_MIN = (3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 13.0, 16.0, 20.0, 30.0)
N_PEAKS = 10
PEAK_MASK_FRACTION = 0.005
PEAK_MASK_FACTORS = (1.0, 1.0 / 3.0, 0.5, 2.0, 3.0)
UPPER_CLIP_SIGMA = 5.0
MIN_CADENCES = 200

# cross-aperture clusters
CLUSTER_PERIOD_TOL = 0.005
CLUSTER_EPOCH_TOL_MIN = 5.0
CLUSTER_SDE_MIN = 7.0

# harmonics and period relations
HARMONIC_FACTORS = (0.25, 1.0 / 3.0, 0.5, 1.0, 2.0, 3.0, 4.0)
HARMONIC_NAMES = ("p_over_4", "p_over_3", "p_over_2", "p", "2p", "3p", "4p")
PERIOD_TOL = 0.02
RELATION_TOL = 0.01
MIN_WINDOW_OVERLAP = 0.50

# SI and astronomical values
G_SI = 6.67430e-11
GM_SUN_SI = 1.32712440e20
R_SUN_M = 6.957e8
R_JUP_M = 6.9911e7
STAR_DENSITY_G_CM3 = 3.85e5
STAR_RADIUS_REARTH = 0.013 * 109.076
MAX_DUTY_CYCLE = 0.20
HOST_MASS_MSUN = 0.4
HOST_RADIUS_RSUN = 0.018
COMPANION_MAX_RJUP = 2.0
CADENCE_SMEAR_MIN = 3.34
P_ALIAS_MIN_D = 0.10
RHO_MIN_G_CM3 = 7.87
RHO_JUP_G_CM3 = 1.33
PILEUP_LIMIT = 50
PILEUP_BASE = 1.001

# detector geometry and orbits
X_MIN, X_MAX = 44.0, 2093.0
Y_MIN, Y_MAX = 0.0, 2049.0
EDGE_PIXELS = 6.0
FIRST_ORBIT = 9
ORBITS_PER_SECTOR = 2
ORBITS_PER_SECTOR_EXCEPTIONS = {97: 4, 98: 4}

# labels
LABELS = (
    "planet_like",
    "wide_transit_like",
    "eclipsing_binary_or_pceb",
    "stellar_variability",
    "instrumental_or_systematic",
    "centroid_contaminant",
    "uncertain",
    "skip",
)
STRONG_LABELS = LABELS[:6]
TRUTH_MATCH_MODES = ("bls_top1_recovered", "bls_topn_recovered", "bls_topn_harmonic_match")
TRUE_TEXT = ("1", "true", "t", "yes", "y")

# magnitude bins of the recovery reports (left-closed)
TMAG_EDGES = (17.0, 18.0, 19.0)
TMAG_LABELS = ("Tmag < 17", "17 <= Tmag < 18", "18 <= Tmag < 19", "Tmag >= 19")

# The patterns by which reviewer notes are read. Order matters.
REFOLD_NOTES = (
    (r"(?i)\bp\s*/\s*2\b|refold\s+(?:at|to|on)\s+p\s*/\s*2|half[-\s]*period|half\s+of\s+(?:the\s+)?period", 0.5, "half_period_note"),
    (r"(?i)\b2\s*\*?\s*p\b|\b2p\b|double[-\s]*period|twice\s+(?:the\s+)?period", 2.0, "double_period_note"),
    (r"(?i)\b(possible\s+)?harmonic\b|\bwrong\s+period\b|\bwrong\s+fold\b", None, "harmonic_note"),
)
NOTE_WORDS = {r"\bquarter[- ]period\b": 0.25, r"\bhalf[- ]period\b": 0.5, r"\b(?:double|twice)[- ](?:the[- ])?period\b": 2.0, r"\btriple[- ](?:the[- ])?period\b": 3.0}
NOTE_DIVISOR = r"\bp\s*/\s*(\d+(?:\.\d+)?)\b"
NOTE_MULTIPLIER = r"(?<![\w/])(\d+(?:\.\d+)?)\s*\*?\s*p\b"
