"""Fixed values that must equal the reference's for equal results."""

# --- fixed values (reference semantics) ---------------------------------

# The six vital signs, in column order.
VITALS = [
    "heart_rate", "systolic_bp", "diastolic_bp",
    "spo2", "temperature_c", "respiratory_rate",
]

# Plausible ranges (lo, hi) used for scaling and for the clean-reading filter.
VITAL_RANGES = {
    "heart_rate":       (20.0, 300.0),
    "systolic_bp":      (40.0, 280.0),
    "diastolic_bp":     (10.0, 180.0),
    "spo2":             (50.0, 100.0),
    "temperature_c":    (33.0, 42.0),
    "respiratory_rate": (4.0, 60.0),
}

# Out-of-range limits of the patient summary (only three vitals are checked).
OOR_LIMITS = {
    "heart_rate":       (20.0, 300.0),
    "spo2":             (50.0, 100.0),
    "respiratory_rate": (4.0, 60.0),
}

# Valid ICD-9 codes.
VALID_ICD9 = ["41001", "41071", "4280", "4019", "25000",
              "496", "2724", "5849", "51881", "99592"]

# Accepted values of the column checks.
ACCEPTED_GENDER = ["M", "F"]
ACCEPTED_ADMISSION_TYPE = ["EMERGENCY", "ELECTIVE", "URGENT"]

# Clean-reading filter: readings between lo and hi * 1.5.
CLEAN_UPPER_STRETCH = 1.5
# Anomaly threshold percentile of training errors.
ANOMALY_PERCENTILE = 0.95

# Rule-based quality score weights: missing, out-of-range, invalid code.
W_MISSING, W_OOR, W_ICD = 0.3, 0.2, 0.2

# Trust flag: score below this is flagged.
TRUST_FLAG_BELOW = 60.0
# Label rule: invalid-code share above this, or more anomaly flags than this.
LABEL_ICD_SHARE = 0.25
LABEL_MAX_ANOMALY_FLAGS = 2

# Trust model features, in column order.
TRUST_FEATURES = [
    "total_missing_vitals", "total_chart_rows",
    "hr_oor_count", "spo2_oor_count", "rr_oor_count",
    "invalid_icd_count", "raw_dq_score",
    "avg_recon_error", "los_hours",
]
# Boosted trees: 200 trees, depth 4, rate 0.05, subsample 0.8, seed 42.
GBT_TREES, GBT_DEPTH, GBT_RATE, GBT_SUBSAMPLE, SEED = 200, 4, 0.05, 0.8, 42
# Hold-out share of the trust split (1 in 5).
TEST_BUCKETS = 5

# Components of the reconstruction model (six vitals).
PCA_COMPONENTS = 3

# Review: least trusted flagged admissions, and readings shown per admission.
REVIEW_TOP_N = 10
SAMPLE_READINGS = 15

# Dashboard: histogram bins over 0-100, random sample size, failure types.
HIST_BINS = 40
SCATTER_SAMPLE = 1000
FAILURE_TYPES = {
    "Missing vitals": "total_missing_vitals",
    "HR out-of-range": "hr_oor_count",
    "SpO2 OOR": "spo2_oor_count",
    "RR OOR": "rr_oor_count",
    "Invalid ICD": "invalid_icd_count",
}

# Anonymisation salt used only for fixtures; the command line asks for --salt or CARELENS_SALT.
FIXTURE_SALT = "dev-salt-change-in-prod"

# Detectors of our own definition (the reference promises them without code).
GAP_MINUTES = 240          # time gap over 4 h
SPIKE_RANGE_SHARE = 0.5    # jump over half of the plausible range
