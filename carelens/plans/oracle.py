"""DuckDB SQL for every SQL-checkable query (the correctness oracle).

Views customer, orders and lineitem are registered by the caller.  The raw
tables are derived with the same expressions as ``sources/fixtures.py``;
staging and marts follow the reference SQL.  Averages are rounded to six
digits and HUGEINT sums cast to BIGINT, as in the Spark queries.
"""

SALT = "dev-salt-change-in-prod"

# Fixed values.
VITALS = ["heart_rate", "systolic_bp", "diastolic_bp", "spo2", "temperature_c", "respiratory_rate"]
GENDERS = ["M", "F"]
CODES = ["41001", "41071", "4280", "4019", "25000", "496", "2724", "5849", "51881", "99592"]


def _hours(start: str, end: str) -> str:
    """Hour boundaries between two timestamps."""
    return f"(epoch_us(date_trunc('hour', {end})) - epoch_us(date_trunc('hour', {start}))) // 3600000000"


RAW = f"""
raw_patients AS (
  SELECT substr(sha256('{SALT}' || cast(c_custkey AS varchar)), 1, 16) AS subject_id,
         CASE WHEN c_custkey % 20 = 19 THEN 'f' WHEN c_custkey % 25 = 24 THEN 'U'
              WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
         cast(18 + c_custkey % 78 AS integer) AS anchor_age,
         cast(2100 + c_custkey % 81 AS integer) AS anchor_year
  FROM customer),
adm0 AS (
  SELECT o_orderkey, o_custkey, o_orderpriority,
         cast(o_orderdate AS timestamp) + interval 1 minute * cast(o_orderkey % 1440 AS integer) AS admittime
  FROM orders),
adm_key AS (
  SELECT substr(sha256('{SALT}' || cast(o_orderkey + 100000 AS varchar)), 1, 16) AS hadm_id,
         substr(sha256('{SALT}' || cast(o_custkey AS varchar)), 1, 16) AS subject_id,
         admittime,
         admittime + interval 1 minute * cast(CASE WHEN o_orderkey % 100 = 99 THEN -300
                                                  ELSE 120 + (o_orderkey * 7919) % 43080 END AS integer) AS dischtime,
         CASE o_orderpriority WHEN '1-URGENT' THEN ' urgent ' WHEN '5-LOW' THEN 'ELECTIVE'
              ELSE 'Emergency' END AS admission_type,
         cast(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS integer) AS hospital_expire_flag,
         o_orderkey
  FROM adm0),
raw_admissions AS (
  SELECT hadm_id, subject_id, admittime, dischtime, admission_type, hospital_expire_flag FROM adm_key),
raw_diagnoses_icd AS (
  SELECT substr(sha256('{SALT}' || cast(l_orderkey + 100000 AS varchar)), 1, 16) AS hadm_id,
         cast(l_linenumber AS integer) AS seq_num,
         CASE WHEN l_partkey % 33 = 0 THEN 'INVALID'
              ELSE list_extract({CODES},
                                cast(l_suppkey % 10 + 1 AS integer)) END AS icd9_code
  FROM lineitem WHERE l_orderkey % 40 <> 1),
ce0 AS (
  SELECT l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, a.hadm_id, a.subject_id, a.admittime
  FROM lineitem l JOIN adm_key a ON a.o_orderkey = l.l_orderkey),
ce1 AS (
  SELECT * FROM ce0 UNION ALL SELECT * FROM ce0 WHERE l_partkey % 50 = 7),
raw_chartevents AS (
  SELECT hadm_id, subject_id,
         admittime + interval 1 minute * cast((l_linenumber // 2) * 60
              + CASE WHEN l_partkey % 50 = 3 THEN 300 + l_suppkey * 11 ELSE 0 END AS integer) AS charttime,
         CASE WHEN l_suppkey % 50 = 0 THEN 'glucose'
              ELSE list_extract({VITALS},
                                cast(l_suppkey % 6 + 1 AS integer)) END AS vital_name,
         CASE WHEN l_partkey % 20 = 0 THEN NULL
              ELSE (list_extract([40.0::double, 60.0, 30.0, 70.0, 35.0, 8.0], cast(l_suppkey % 6 + 1 AS integer))
                    + list_extract([140.0::double, 160.0, 100.0, 30.0, 5.5, 32.0], cast(l_suppkey % 6 + 1 AS integer))
                      * l_quantity / 50.0)
                   * CASE WHEN l_partkey % 33 = 1 THEN 2.0::double + (l_partkey % 5) * 0.5::double ELSE 1.0::double END
         END AS valuenum
  FROM ce1)"""

STAGING = f"""
stg_patients AS (
  SELECT * REPLACE (upper(gender) AS gender) FROM raw_patients
  WHERE list_contains({GENDERS}, gender) AND subject_id IS NOT NULL),
stg_admissions AS (
  SELECT * REPLACE (upper(trim(admission_type)) AS admission_type), {_hours('admittime', 'dischtime')} AS los_hours
  FROM raw_admissions
  WHERE dischtime - admittime >= interval 0 second AND NOT (hadm_id IS NULL OR subject_id IS NULL)),
stg_chartevents AS (
  FROM raw_chartevents WHERE hadm_id IS NOT NULL AND list_contains({VITALS}, vital_name)),
stg_diagnoses_icd AS (
  SELECT *, list_contains({CODES}, icd9_code) AS is_valid_icd
  FROM (SELECT * REPLACE (upper(trim(icd9_code)) AS icd9_code) FROM raw_diagnoses_icd)
  WHERE hadm_id IS NOT NULL AND icd9_code IS NOT NULL)"""

# One row per time point; a vital is missing when none of its readings there has a value.
_WIDE = ", ".join(f"max(valuenum) FILTER (vital_name = '{v}') AS {v}" for v in VITALS)
# Counted outside of [lo, hi] for the quality score.
_OUTSIDE = ", ".join(f"count(*) FILTER (NOT {v} BETWEEN {lo} AND {hi}) AS {name}_oor_count" for name, v, lo, hi in (
    ("hr", "heart_rate", 20, 300), ("spo2", "spo2", 50, 100), ("rr", "respiratory_rate", 4, 60)))
_MEANS = ", ".join(f"avg({v}) AS avg_{v}" for v in VITALS if v != "diastolic_bp")

MARTS = f"""
time_points AS (
  SELECT hadm_id, subject_id, charttime, {_WIDE},
         ({len(VITALS)} - count(DISTINCT vital_name) FILTER (valuenum IS NOT NULL))::integer AS missing_vitals_count
  FROM stg_chartevents GROUP BY ALL),
mart_icu_vitals AS (
  SELECT t.*, a.* EXCLUDE (hadm_id, subject_id, dischtime), {_hours('a.admittime', 't.charttime')} AS hours_since_admit
  FROM time_points t LEFT JOIN stg_admissions a ON t.hadm_id = a.hadm_id),
stays AS (
  SELECT hadm_id, subject_id, admission_type, hospital_expire_flag, los_hours, {_MEANS}, {_OUTSIDE},
         sum(missing_vitals_count)::bigint AS total_missing_vitals, count(*) AS total_chart_rows,
         min(charttime) AS first_chart_time, max(charttime) AS last_chart_time
  FROM mart_icu_vitals GROUP BY ALL),
with_codes AS (
  SELECT stays.*, coalesce(c.n, 0) AS total_diagnoses, coalesce(c.bad, 0) AS invalid_icd_count
  FROM stays LEFT JOIN (SELECT hadm_id, count(*) AS n, count(*) FILTER (NOT is_valid_icd) AS bad
                        FROM stg_diagnoses_icd GROUP BY hadm_id) c ON c.hadm_id = stays.hadm_id),
-- Shares of bad items, at most 1; an admission without codes counts as all bad.
shares AS (
  SELECT *, least(total_missing_vitals / ({len(VITALS)} * total_chart_rows)::double, 1) AS missing_share,
         least((hr_oor_count + spo2_oor_count + rr_oor_count) / total_chart_rows::double, 1) AS outside_share,
         CASE total_diagnoses WHEN 0 THEN 1 ELSE invalid_icd_count / total_diagnoses::double END AS bad_code_share
  FROM with_codes),
mart_patient_summary AS (
  SELECT * EXCLUDE (missing_share, outside_share, bad_code_share),
         round((1 - 0.3 * missing_share - 0.2 * outside_share - 0.2 * bad_code_share) * 100, 1) AS raw_dq_score
  FROM shares)"""


def with_base(*ctes: str) -> str:
    """WITH clause: raw, staging, marts, then extra CTEs."""
    parts = [RAW, STAGING, MARTS] + [c for c in ctes if c]
    return "WITH " + ",".join(parts)


def q(select: str, *ctes: str) -> str:
    return with_base(*ctes) + "\n" + select


SUMMARY_COLS = """hadm_id, subject_id, admission_type, hospital_expire_flag, los_hours, total_chart_rows,
  total_missing_vitals, round(avg_heart_rate, 6) AS avg_heart_rate, round(avg_systolic_bp, 6) AS avg_systolic_bp,
  round(avg_spo2, 6) AS avg_spo2, round(avg_temperature_c, 6) AS avg_temperature_c,
  round(avg_respiratory_rate, 6) AS avg_respiratory_rate, hr_oor_count, spo2_oor_count, rr_oor_count,
  first_chart_time, last_chart_time, total_diagnoses, invalid_icd_count, raw_dq_score"""

ORACLE: dict[str, str] = {
    "anon_ids": f"""SELECT c_custkey AS raw_id,
        substr(sha256('{SALT}' || cast(c_custkey AS varchar)), 1, 16) AS anon_id FROM customer""",
    "stg_patients": q("SELECT * FROM stg_patients"),
    "stg_admissions": q("SELECT * FROM stg_admissions"),
    "stg_chartevents": q("SELECT * FROM stg_chartevents"),
    "stg_diagnoses": q("SELECT * FROM stg_diagnoses_icd"),
    "mart_vitals": q("SELECT * FROM mart_icu_vitals"),
    "mart_summary": q(f"SELECT {SUMMARY_COLS} FROM mart_patient_summary"),
}

# --- anomaly preparation, mean model, fixed trust --------------------------
SCORE = """
ranges AS (
  SELECT * FROM (VALUES ('heart_rate', 20.0::double, 300.0::double), ('systolic_bp', 40.0, 280.0),
                        ('diastolic_bp', 10.0, 180.0), ('spo2', 50.0, 100.0),
                        ('temperature_c', 33.0, 42.0), ('respiratory_rate', 4.0, 60.0)) r(vital_name, lo, hi)),
clean AS (
  SELECT c.hadm_id, c.subject_id, c.charttime, c.vital_name, c.valuenum
  FROM stg_chartevents c JOIN ranges r USING (vital_name)
  WHERE c.valuenum IS NOT NULL AND c.valuenum BETWEEN r.lo AND r.hi * 1.5),
pivot_scoring AS (SELECT hadm_id, charttime, {wide} FROM stg_chartevents GROUP BY ALL),
medians AS (SELECT {median_cols} FROM pivot_scoring),
clean_wide AS (SELECT hadm_id, charttime, {clean_cols} FROM pivot_scoring),
train_matrix AS (
  SELECT c.hadm_id, c.charttime, {scaled_train} FROM clean_wide c, medians m WHERE {any_present}),
means AS (SELECT {mean_cols} FROM train_matrix),
train_err AS (SELECT {err_train} AS e FROM train_matrix, means),
thr AS (SELECT quantile_cont(e, 0.95) AS threshold, avg(e) AS mean_error FROM train_err),
imputed AS (
  SELECT p.hadm_id, p.charttime, {imputed_cols} FROM pivot_scoring p, medians m),
scaled_imp AS (
  SELECT p.hadm_id, p.charttime, {raw_cols}, {scaled_imp} FROM pivot_scoring p, medians m),
scores AS (
  SELECT s.hadm_id, s.charttime, {plain_cols}, {err_scored} AS reconstruction_error
  FROM scaled_imp s, means mm),
anomaly_scores AS (
  SELECT s.*, CASE WHEN s.reconstruction_error > t.threshold THEN 1 ELSE 0 END AS anomaly_flag
  FROM scores s, thr t),
anomaly_agg AS (
  SELECT hadm_id, avg(reconstruction_error) AS avg_recon_error, sum(anomaly_flag)::bigint AS flagged_count
  FROM anomaly_scores GROUP BY hadm_id),
features AS (
  SELECT s.* EXCLUDE (avg_recon_error), coalesce(s.avg_recon_error, 0) AS avg_recon_error,
         (hr_oor_count + spo2_oor_count > 0 OR 4 * invalid_icd_count > total_diagnoses
          OR coalesce(flagged_count, 0) > 2)::integer AS has_dq_problem
  FROM (FROM mart_patient_summary LEFT JOIN anomaly_agg USING (hadm_id)) s),
trust AS (
  SELECT hadm_id, raw_dq_score AS trust_score, raw_dq_score < 60 AS dq_flagged FROM mart_patient_summary),
board AS (
  SELECT s.*, t.trust_score, t.dq_flagged FROM mart_patient_summary s LEFT JOIN trust t USING (hadm_id))"""

RANGES = {"heart_rate": (20.0, 300.0), "systolic_bp": (40.0, 280.0), "diastolic_bp": (10.0, 180.0),
          "spo2": (50.0, 100.0), "temperature_c": (33.0, 42.0), "respiratory_rate": (4.0, 60.0)}


def _scale(expr: str, v: str) -> str:
    lo, hi = RANGES[v]
    x = f"(({expr}) - {lo!r}::double) / {hi - lo!r}::double"
    return f"CASE WHEN ({expr}) IS NULL THEN NULL ELSE least(greatest({x}, 0.0::double), 1.0::double) END"


def _err(prefix: str, mean_prefix: str) -> str:
    terms = [f"({prefix}{v} - {mean_prefix}{v}) * ({prefix}{v} - {mean_prefix}{v})" for v in VITALS]
    return "(" + " + ".join(terms) + ") / 6.0::double"


SCORE = SCORE.format(
    wide=_WIDE,
    clean_cols=", ".join(f"CASE WHEN {v} BETWEEN {RANGES[v][0]!r} AND {RANGES[v][1] * 1.5!r} THEN {v} END AS {v}"
                         for v in VITALS),
    scaled_train=", ".join(f"{_scale(f'coalesce(c.{v}, m.{v})', v)} AS {v}" for v in VITALS),
    any_present="(" + " OR ".join(f"c.{v} IS NOT NULL" for v in VITALS) + ")",
    mean_cols=", ".join(f"round(avg({v}), 9) AS m_{v}" for v in VITALS),
    err_train=_err("", "m_"),
    median_cols=", ".join(f"round(median({v}), 9) AS {v}" for v in VITALS),
    imputed_cols=", ".join(f"coalesce(p.{v}, m.{v}) AS {v}" for v in VITALS),
    raw_cols=", ".join(f"p.{v}" for v in VITALS),
    scaled_imp=", ".join(f"{_scale(f'coalesce(p.{v}, m.{v})', v)} AS s_{v}" for v in VITALS),
    plain_cols=", ".join(f"s.{v}" for v in VITALS),
    err_scored=_err("s.s_", "mm.m_"),
)


def sq(select: str, *ctes: str) -> str:
    return with_base(SCORE, *ctes) + "\n" + select


FLAGGED8 = ("hadm_id, trust_score, admission_type, los_hours, total_missing_vitals, hr_oor_count, "
            "invalid_icd_count, raw_dq_score")


def _fmt(expr: str, pattern: str) -> str:
    return f"coalesce(printf('{pattern}', ({expr})::double), 'nan')"


CONTEXT = ("'Admission ' || s.hadm_id || ': type=' || coalesce(s.admission_type, 'None')"
           f" || ', LOS=' || {_fmt('s.los_hours', '%.0f')}"
           f" || 'h, trust=' || {_fmt('t.trust_score', '%.1f')}"
           f" || '/100, dq_score=' || {_fmt('s.raw_dq_score', '%.1f')}"
           f" || '/100 | missing_vitals=' || {_fmt('s.total_missing_vitals', '%.0f')}"
           f" || '/' || {_fmt('s.total_chart_rows', '%.0f')}"
           f" || ', hr_oor=' || {_fmt('s.hr_oor_count', '%.0f')}"
           f" || ', spo2_oor=' || {_fmt('s.spo2_oor_count', '%.0f')}"
           f" || ', invalid_icd=' || {_fmt('s.invalid_icd_count', '%.0f')}"
           f" || '/' || {_fmt('s.total_diagnoses', '%.0f')}")

VERDICT = (f"'Trust score: ' || {_fmt('trust_score', '%.1f')} || '/100 (' || "
           "CASE WHEN dq_flagged THEN 'FLAGGED' ELSE 'CLEAN' END || ')'")

REVIEW = f"""
wl AS (
  SELECT hadm_id, trust_score,
         cast(row_number() OVER (ORDER BY trust_score, hadm_id) AS integer) AS review_rank
  FROM trust WHERE dq_flagged ORDER BY trust_score, hadm_id LIMIT 10),
flagged_ids AS (SELECT hadm_id FROM trust WHERE dq_flagged),
sample AS (
  SELECT hadm_id, cast(rn AS integer) AS rn, charttime, vital_name, valuenum FROM (
    SELECT c.*, row_number() OVER (PARTITION BY hadm_id
                                   ORDER BY charttime, vital_name, valuenum NULLS FIRST) AS rn
    FROM stg_chartevents c WHERE hadm_id IN (SELECT hadm_id FROM flagged_ids)) x
  WHERE rn <= 15),
wl_sample AS (
  SELECT hadm_id, string_agg(strftime(charttime, '%Y-%m-%d %H:%M:%S') || ' ' || vital_name || ' '
                             || coalesce(cast(valuenum AS varchar), 'NaN'), chr(10) ORDER BY rn) AS vitals_sample
  FROM sample WHERE hadm_id IN (SELECT hadm_id FROM wl) GROUP BY hadm_id)"""

CHECK_RULES = [
    ("stg_patients", "subject_id", "not_null"), ("stg_patients", "subject_id", "unique"),
    ("stg_patients", "gender", "not_null"), ("stg_patients", "gender", "accepted_values", ["M", "F"]),
    ("stg_patients", "anchor_age", "not_null"),
    ("stg_admissions", "hadm_id", "not_null"), ("stg_admissions", "hadm_id", "unique"),
    ("stg_admissions", "subject_id", "not_null"), ("stg_admissions", "los_hours", "not_null"),
    ("stg_admissions", "admission_type", "accepted_values", ["EMERGENCY", "ELECTIVE", "URGENT"]),
    ("stg_chartevents", "hadm_id", "not_null"), ("stg_chartevents", "vital_name", "not_null"),
    ("stg_chartevents", "vital_name", "accepted_values", VITALS),
    ("stg_diagnoses_icd", "hadm_id", "not_null"), ("stg_diagnoses_icd", "icd9_code", "not_null"),
    ("stg_diagnoses_icd", "is_valid_icd", "not_null"),
    ("mart_icu_vitals", "hadm_id", "not_null"), ("mart_icu_vitals", "charttime", "not_null"),
    ("mart_icu_vitals", "missing_vitals_count", "not_null"),
    ("mart_patient_summary", "hadm_id", "not_null"), ("mart_patient_summary", "hadm_id", "unique"),
]


def _check_sql(test: str) -> str:
    parts = []
    for r in CHECK_RULES:
        if r[2] != test:
            continue
        m, c = r[0], r[1]
        if test == "not_null":
            f = f"(SELECT count(*) FROM {m} WHERE {c} IS NULL)"
        elif test == "unique":
            f = (f"(SELECT count(*) FROM (SELECT {c} FROM {m} WHERE {c} IS NOT NULL "
                 f"GROUP BY {c} HAVING count(*) > 1) d)")
        else:
            vals = ", ".join(f"'{v}'" for v in r[3])
            f = f"(SELECT count(DISTINCT {c}) FROM {m} WHERE {c} NOT IN ({vals}))"
        parts.append(f"SELECT '{m}' AS model, '{c}' AS column_name, '{test}' AS test, {f}::bigint AS failures")
    return " UNION ALL ".join(parts)


OOR = {"heart_rate": (20.0, 300.0), "spo2": (50.0, 100.0), "respiratory_rate": (4.0, 60.0)}
SPIKE = {v: 0.5 * (hi - lo) for v, (lo, hi) in RANGES.items()}

DETECT = f"""
long_vitals AS (
  {" UNION ALL ".join(f"SELECT hadm_id, charttime, '{v}' AS vital_name, {v} AS value FROM mart_icu_vitals" for v in VITALS)}),
j5 AS (
  SELECT hadm_id, charttime,
         CASE WHEN value IS NULL THEN 'missing_vital'
              WHEN {" OR ".join(f"(vital_name = '{v}' AND (value < {lo} OR value > {hi}))" for v, (lo, hi) in OOR.items())}
              THEN 'out_of_range' END AS failure_type,
         vital_name AS item, value
  FROM long_vitals),
dups AS (
  SELECT hadm_id, subject_id, charttime, vital_name, valuenum, count(*) AS copies
  FROM stg_chartevents GROUP BY hadm_id, subject_id, charttime, vital_name, valuenum HAVING count(*) > 1),
tpts AS (SELECT DISTINCT hadm_id, charttime FROM stg_chartevents WHERE charttime IS NOT NULL),
tlag AS (
  SELECT hadm_id, lag(charttime) OVER (PARTITION BY hadm_id ORDER BY charttime) AS prev_charttime, charttime
  FROM tpts),
gaps AS (
  SELECT hadm_id, prev_charttime, charttime,
         (epoch_us(charttime) - epoch_us(prev_charttime)) / 60000000.0::double AS gap_minutes
  FROM tlag WHERE prev_charttime IS NOT NULL
    AND (epoch_us(charttime) - epoch_us(prev_charttime)) / 60000000.0::double > 240),
spike_limits AS (
  SELECT * FROM (VALUES {", ".join(f"('{v}', {lim!r}::double)" for v, lim in SPIKE.items())}) s(vital_name, lim)),
vlag AS (
  SELECT hadm_id, vital_name, lag(charttime) OVER w AS prev_charttime, charttime,
         lag(valuenum) OVER w AS prev_value, valuenum
  FROM stg_chartevents
  WHERE valuenum IS NOT NULL AND charttime IS NOT NULL
  WINDOW w AS (PARTITION BY hadm_id, vital_name ORDER BY charttime, valuenum)),
spikes AS (
  SELECT v.hadm_id, v.vital_name, v.prev_charttime, v.charttime, v.prev_value, v.valuenum,
         v.valuenum - v.prev_value AS jump
  FROM vlag v JOIN spike_limits l USING (vital_name)
  WHERE v.prev_value IS NOT NULL AND abs(v.valuenum - v.prev_value) > l.lim),
report AS (
  SELECT hadm_id, charttime, failure_type, item, value FROM j5 WHERE failure_type IS NOT NULL
  UNION ALL
  SELECT hadm_id, NULL::timestamp, 'invalid_icd', icd9_code, NULL::double FROM stg_diagnoses_icd WHERE NOT is_valid_icd
  UNION ALL
  SELECT hadm_id, charttime, 'duplicate', vital_name, valuenum FROM dups
  UNION ALL
  SELECT hadm_id, charttime, 'time_gap', NULL::varchar, gap_minutes FROM gaps
  UNION ALL
  SELECT hadm_id, charttime, 'spike', vital_name, jump FROM spikes
  UNION ALL
  SELECT hadm_id, charttime, 'anomaly', NULL::varchar, reconstruction_error FROM anomaly_scores WHERE anomaly_flag = 1)"""

ORACLE.update({
    "clean_readings": sq("SELECT * FROM clean"),
    "pivot_scoring": sq("SELECT * FROM pivot_scoring"),
    "scaled_vitals": sq("SELECT hadm_id, charttime, "
                        + ", ".join(f"{_scale(v, v)} AS {v}" for v in VITALS) + " FROM pivot_scoring"),
    "column_medians": sq("SELECT * FROM medians"),
    "imputed_vitals": sq("SELECT * FROM imputed"),
    "shortest_column": sq("SELECT min(n) AS n_rows FROM "
                          "(SELECT vital_name, count(*) AS n FROM clean GROUP BY vital_name) c"),
    "train_matrix": sq("SELECT * FROM train_matrix"),
    "anomaly_threshold": sq("SELECT round(threshold, 9) AS threshold, round(mean_error, 9) AS mean_error FROM thr"),
    "anomaly_flags_mean": sq("SELECT * FROM anomaly_scores"),
    "anomaly_rollup": sq("SELECT hadm_id, round(avg_recon_error, 6) AS avg_recon_error, flagged_count "
                         "FROM anomaly_agg"),
    "scoring_summary": sq("SELECT count(*) AS n_rows, sum(anomaly_flag)::bigint AS n_flagged, "
                          "round(sum(anomaly_flag) / count(*), 6) AS flagged_share FROM anomaly_scores"),
    "trust_features": sq("SELECT hadm_id, total_missing_vitals, total_chart_rows, hr_oor_count, "
                         "spo2_oor_count, rr_oor_count, invalid_icd_count, raw_dq_score, los_hours, "
                         "round(avg_recon_error, 6) AS avg_recon_error, has_dq_problem FROM features"),
    "label_balance": sq("SELECT sum(has_dq_problem)::bigint AS positives, "
                        "round(sum(has_dq_problem) / count(*), 6) AS positive_share, "
                        "count(*) AS total FROM features"),
    "kpis": sq("SELECT count(*) AS total_admissions, coalesce(sum(dq_flagged::integer), 0)::bigint AS flagged, "
               "round(avg(dq_flagged::integer::double), 6) AS flagged_share, "
               "round(avg(trust_score), 6) AS avg_trust_score, "
               "round(avg(total_missing_vitals), 6) AS avg_missing_vitals FROM board"),
    "failures_by_type": sq(" UNION ALL ".join(
        f"SELECT '{n}' AS failure_type, count_if({c} > 0)::bigint AS admissions FROM board"
        for n, c in [("Missing vitals", "total_missing_vitals"), ("HR out-of-range", "hr_oor_count"),
                     ("SpO2 OOR", "spo2_oor_count"), ("RR OOR", "rr_oor_count"),
                     ("Invalid ICD", "invalid_icd_count")])),
    "trust_histogram": sq("SELECT bin, bin * 2.5::double AS bin_start, count(*) AS admissions FROM "
                          "(SELECT cast(least(floor(trust_score / 2.5), 39) AS integer) AS bin FROM board "
                          "WHERE trust_score IS NOT NULL) b GROUP BY bin"),
    "flagged_filter": sq(f"SELECT {FLAGGED8} FROM board WHERE dq_flagged = true "
                         "AND total_missing_vitals > 0 AND invalid_icd_count > 0"),
    "flagged_sorted": sq(f"SELECT {FLAGGED8} FROM board WHERE dq_flagged = true ORDER BY trust_score, hadm_id"),
    "worklist": sq("SELECT * FROM wl", REVIEW),
    "vitals_sample": sq("SELECT * FROM sample", REVIEW),
    "record_context": sq(f"SELECT s.hadm_id, {CONTEXT} AS record_context FROM mart_patient_summary s "
                         "JOIN trust t USING (hadm_id) WHERE t.dq_flagged"),
    "trust_verdict": sq(f"SELECT hadm_id, {VERDICT} AS trust_verdict FROM trust"),
    "review_table": sq(f"""SELECT w.review_rank, w.hadm_id, w.trust_score,
        coalesce((SELECT {CONTEXT} FROM mart_patient_summary s JOIN trust t USING (hadm_id) WHERE s.hadm_id = w.hadm_id),
                 'No record found for hadm_id=' || w.hadm_id) AS record_context,
        (SELECT {VERDICT} FROM trust t WHERE t.hadm_id = w.hadm_id) AS trust_verdict,
        coalesce(ws.vitals_sample, 'No vitals found for hadm_id=' || w.hadm_id) AS vitals_sample,
        'Review admission ' || w.hadm_id || ' and provide repair recommendations.' AS request
      FROM wl w LEFT JOIN wl_sample ws USING (hadm_id)""", REVIEW),
    "check_not_null": q(_check_sql("not_null")),
    "check_unique": q(_check_sql("unique")),
    "check_accepted": q(_check_sql("accepted_values")),
    "oor_detail": sq("SELECT * FROM j5 WHERE failure_type IS NOT NULL", DETECT),
    "icd_mismatch": q("SELECT hadm_id, seq_num, icd9_code FROM stg_diagnoses_icd WHERE NOT is_valid_icd"),
    "dup_readings": sq("SELECT * FROM dups", DETECT),
    "time_gaps": sq("SELECT * FROM gaps", DETECT),
    "spikes": sq("SELECT * FROM spikes", DETECT),
    "failure_report": sq("SELECT * FROM report", DETECT),
    "failure_counts": sq("SELECT failure_type, count(*) AS failures, count(DISTINCT hadm_id) AS admissions "
                         "FROM report GROUP BY failure_type", DETECT),
})

ORACLE["anomalous_rows"] = sq("SELECT hadm_id, charttime, 'anomaly' AS failure_type, NULL::varchar AS item, "
                              "reconstruction_error AS value FROM anomaly_scores WHERE anomaly_flag = 1")

ORACLE["scatter_sample"] = sq("SELECT hadm_id, raw_dq_score, trust_score, dq_flagged FROM board "
                              "ORDER BY sha256(hadm_id || ':42'), hadm_id LIMIT 1000")

# --- split, scaler, metrics, run log ----------------------------------------
# One in five rows of each label (rounded up), by the smallest key.
SPLIT = """
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY has_dq_problem ORDER BY sha256(hadm_id || ':42')) AS place,
         count(*) OVER (PARTITION BY has_dq_problem) AS of_label
  FROM features),
split AS (SELECT *, 5 * (place - 1) < of_label AS is_test FROM keyed),
ranked AS (
  SELECT has_dq_problem AS label, trust_flag,
         rank() OVER (ORDER BY raw_dq_score DESC)
           + (count(*) OVER (PARTITION BY raw_dq_score) - 1) / 2 AS mean_rank
  FROM (SELECT *, raw_dq_score < 60 AS trust_flag FROM split WHERE is_test)),
measured AS (
  SELECT sum(label)::double AS p, sum(1 - label)::double AS n, sum(mean_rank) FILTER (label = 1) AS rank_sum,
         count_if(label = 1 AND trust_flag)::double AS tp, count_if(trust_flag)::double AS hits FROM ranked),
named AS (
  SELECT unnest(['roc_auc', 'precision', 'recall', 'f1', 'n', 'positives']) AS metric,
         unnest([CASE WHEN p * n > 0 THEN (rank_sum - p * (p + 1) / 2) / (p * n) END,
                 CASE WHEN hits > 0 THEN tp / hits ELSE 0 END, CASE WHEN p > 0 THEN tp / p ELSE 0 END,
                 CASE WHEN hits + p > 0 THEN 2 * tp / (hits + p) ELSE 0 END, n + p, p]) AS value
  FROM measured)"""

FEATURE_LIST = ["total_missing_vitals", "total_chart_rows", "hr_oor_count", "spo2_oor_count", "rr_oor_count",
                "invalid_icd_count", "raw_dq_score", "avg_recon_error", "los_hours"]

ORACLE.update({
    "trust_split": sq("SELECT hadm_id, has_dq_problem, is_test FROM split", SPLIT),
    "scaler_fit": sq(" UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(min(coalesce({f}, 0))::double, 6) AS lo, round(max(coalesce({f}, 0))::double, 6) AS hi "
        "FROM split WHERE NOT is_test" for f in FEATURE_LIST), SPLIT),
    "trust_metrics_fixed": sq("SELECT metric, round(value, 9) AS value FROM named", SPLIT),
    "trust_summary": sq("SELECT count(*) AS n_rows, count_if(dq_flagged)::bigint AS n_flagged, "
                        "round(avg(dq_flagged::integer), 6) AS flagged_share FROM trust"),
    "recent_runs": """
      WITH log AS (
        SELECT 'run-' || event_id // 40 AS run, event_id // 4 % 10 AS step, ts, value,
               ['roc_auc', 'train_loss', 'anomaly_threshold_p95', NULL][event_id % 4 + 1] AS name,
               CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS status
        FROM events WHERE value IS NOT NULL)
      SELECT run, max(ts) AS ts, last(status ORDER BY ts, status) AS status,
             last(value ORDER BY step, ts, value) FILTER (name = 'roc_auc') AS roc_auc,
             last(value ORDER BY step, ts, value) FILTER (name = 'train_loss') AS train_loss,
             last(value ORDER BY step, ts, value) FILTER (name = 'anomaly_threshold_p95') AS anomaly_threshold_p95
      FROM log GROUP BY run ORDER BY ts DESC, run LIMIT 20""",
})

# Counts are exact; that the sketched quantiles lie within their error is the Spark side's audit.
ORACLE["sketch_quantiles"] = sq("SELECT name, n, TRUE AS median_within, TRUE AS p95_within FROM ("
                                + " UNION ALL ".join(f"SELECT '{v}' AS name, count({v}) AS n FROM pivot_scoring" for v in VITALS)
                                + " UNION ALL SELECT 'reconstruction_error', count(e) FROM train_err) x")
# Isotonic regression by its max-min formula: the greatest over earlier starts of the
# least over later ends of the share in between.
ORACLE["trust_calibrated"] = sq("""SELECT * FROM (
  WITH b AS (
    SELECT least(floor((100 - raw_dq_score) / 100 * 1000), 999)::integer AS bin, count(*) AS n,
           sum(has_dq_problem)::bigint AS positives FROM features WHERE raw_dq_score IS NOT NULL GROUP BY 1),
  c AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(positives) OVER w AS cp FROM b WINDOW w AS (ORDER BY bin)),
  spans AS (SELECT x.i AS first, y.i AS last, (y.cp - x.cp + x.positives) / (y.cn - x.cn + x.n) AS share
            FROM c x JOIN c y ON y.i >= x.i),
  least_after AS (SELECT first, last AS i, min(share) OVER (PARTITION BY first ORDER BY last DESC) AS share FROM spans)
  SELECT bin, n, positives, (SELECT round(max(share), 9) FROM least_after l WHERE l.i = c.i) AS calibrated FROM c) t""")

_MESSY = "substr(hadm_id, 2, 1) = 'f' AND charttime IS NOT NULL"
_NO_NUMBER = "substr(hadm_id, 1, 1) = '0' AND valuenum IS NOT NULL"
ORACLE["raw_rejects"] = q(f"""SELECT 'raw_chartevents' AS table_name, concat_ws(',', CASE WHEN {_MESSY} THEN 'charttime:not_timestamp' END,
    CASE WHEN {_NO_NUMBER} THEN 'valuenum:not_double' END) AS reasons, hadm_id, vital_name
  FROM raw_chartevents WHERE ({_MESSY}) OR ({_NO_NUMBER})""")
ORACLE["tolerant_readings"] = q(f"SELECT * FROM stg_chartevents WHERE NOT (coalesce({_MESSY}, FALSE) OR coalesce({_NO_NUMBER}, FALSE))")
ORACLE["stg_diagnoses_by_table"] = q("""SELECT hadm_id, seq_num, icd9_code,
    EXISTS (SELECT 1 FROM raw_diagnoses_icd r WHERE r.seq_num = 1 AND upper(trim(r.icd9_code)) = d.icd9_code) AS is_valid_icd
  FROM stg_diagnoses_icd d""")
ORACLE["trust_split_bucket"] = sq("""SELECT hadm_id, has_dq_problem,
    CAST('0x' || substr(sha256(hadm_id || ':42'), 1, 15) AS BIGINT) % 5 = 0 AS is_test FROM features""")
