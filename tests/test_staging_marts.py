import datetime as dt

from carelens.operators import marts, staging

T = dt.datetime


def test_patients_filter_before_upper(spark):
    df = spark.createDataFrame([("a", "f", 30, 2100), ("b", "F", 40, 2101), ("c", "U", 50, 2102),
                                (None, "M", 1, 1)], "subject_id string, gender string, anchor_age int, anchor_year int")
    out = staging.stage_patients(df).collect()
    assert [(r.subject_id, r.gender) for r in out] == [("b", "F")]


def test_admissions_rules(spark):
    df = spark.createDataFrame([
        ("h1", "s", T(2020, 1, 1, 10, 59), T(2020, 1, 1, 11, 1), " urgent ", 0),
        ("h2", "s", T(2020, 1, 1, 10, 0), T(2020, 1, 1, 10, 0), "Emergency", 1),
        ("h3", "s", T(2020, 1, 1, 10, 0), T(2020, 1, 1, 9, 0), "ELECTIVE", 0),
        (None, "s", T(2020, 1, 1, 10, 0), T(2020, 1, 1, 12, 0), "ELECTIVE", 0)],
        "hadm_id string, subject_id string, admittime timestamp, dischtime timestamp, "
        "admission_type string, hospital_expire_flag int")
    out = {r.hadm_id: r for r in staging.stage_admissions(df).collect()}
    assert set(out) == {"h1", "h2"}
    assert out["h1"].los_hours == 1 and out["h1"].admission_type == "URGENT"
    assert out["h2"].los_hours == 0 and out["h2"].admission_type == "EMERGENCY"


def test_diagnoses_trim_and_validity(spark):
    df = spark.createDataFrame([("h", 1, " 4280 "), ("h", 2, "INVALID"), ("h", 3, None)],
                               "hadm_id string, seq_num int, icd9_code string")
    out = staging.stage_diagnoses(df).collect()
    assert [(r.icd9_code, r.is_valid_icd) for r in out] == [("4280", True), ("INVALID", False)]


def test_chartevents_nan_is_null_and_six_vitals(spark):
    df = spark.createDataFrame([("h", "s", T(2020, 1, 1), "heart_rate", float("nan")),
                                ("h", "s", T(2020, 1, 1), "glucose", 5.0),
                                ("h", "s", T(2020, 1, 1), "spo2", None)],
                               "hadm_id string, subject_id string, charttime timestamp, vital_name string, valuenum double")
    out = staging.stage_chartevents(df).collect()
    assert [(r.vital_name, r.valuenum) for r in out] == [("heart_rate", None), ("spo2", None)]


def _charts(spark, rows):
    return spark.createDataFrame(rows, "hadm_id string, subject_id string, charttime timestamp, "
                                       "vital_name string, valuenum double")


def _adm(spark, rows):
    return spark.createDataFrame(rows, "hadm_id string, subject_id string, admittime timestamp, "
                                       "dischtime timestamp, los_hours long, admission_type string, "
                                       "hospital_expire_flag int")


def test_pivot_takes_max_and_keeps_unmatched(spark):
    t = T(2020, 1, 1, 12)
    charts = _charts(spark, [("h1", "s", t, "heart_rate", 80.0), ("h1", "s", t, "heart_rate", 90.0),
                             ("h9", "s", t, "spo2", 97.0)])
    adm = _adm(spark, [("h1", "s", T(2020, 1, 1, 10, 30), T(2020, 1, 2), 14, "URGENT", 0)])
    out = {r.hadm_id: r for r in marts.icu_vitals(charts, adm).collect()}
    assert out["h1"].heart_rate == 90.0 and out["h1"].missing_vitals_count == 5
    assert out["h1"].hours_since_admit == 2
    assert out["h9"].admittime is None and out["h9"].los_hours is None


def test_summary_scores(spark):
    t = T(2020, 1, 1, 12)
    good = [("h1", "s", t, v, x) for v, x in [("heart_rate", 80.0), ("systolic_bp", 120.0),
                                               ("diastolic_bp", 80.0), ("spo2", 97.0),
                                               ("temperature_c", 37.0), ("respiratory_rate", 16.0)]]
    bad = [("h2", "s", t, "heart_rate", 400.0)]
    charts = _charts(spark, good + bad)
    adm = _adm(spark, [("h1", "s", T(2020, 1, 1), T(2020, 1, 2), 24, "URGENT", 0),
                       ("h2", "s", T(2020, 1, 1), T(2020, 1, 2), 24, "URGENT", 0)])
    dx = spark.createDataFrame([("h2", 1, "BAD", False)], "hadm_id string, seq_num int, icd9_code string, is_valid_icd boolean")
    out = {r.hadm_id: r for r in marts.patient_summary(marts.icu_vitals(charts, adm), dx).collect()}
    assert out["h1"].raw_dq_score == 80.0 and out["h1"].total_diagnoses == 0
    assert out["h2"].raw_dq_score == 35.0 and out["h2"].hr_oor_count == 1


def test_summary_from_readings_equals_reference_shape(spark):
    t0 = T(2020, 1, 1, 12)
    rows = []
    for i in range(40):
        t = t0 + dt.timedelta(minutes=30 * (i % 7))
        rows += [("h1", "s1", t, "heart_rate", 60.0 + i), ("h1", "s1", t, "spo2", 40.0 + i),
                 ("h2", "s2", t, "respiratory_rate", float(i)), ("h3", "s3", t, "heart_rate", None),
                 ("h1", "s9", t, "temperature_c", 37.0)]
    charts = _charts(spark, rows)
    # h1 has two identical admission rows and one differing row; h3 none
    adm = _adm(spark, [("h1", "s1", T(2020, 1, 1), T(2020, 1, 2), 24, "URGENT", 0),
                       ("h1", "s1", T(2020, 1, 1), T(2020, 1, 2), 24, "URGENT", 0),
                       ("h1", "s1", T(2020, 1, 1), T(2020, 1, 3), 48, "ELECTIVE", 1),
                       ("h2", "s2", T(2020, 1, 1), T(2020, 1, 2), 24, "EMERGENCY", 0)])
    dx = spark.createDataFrame([("h2", 1, "BAD", False), ("h2", 2, "4280", True)],
                               "hadm_id string, seq_num int, icd9_code string, is_valid_icd boolean")
    a = marts.patient_summary(marts.icu_vitals(charts, adm), dx)
    b = marts.patient_summary_from_readings(charts, adm, dx)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 6
