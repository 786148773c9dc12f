"""Mart tables: the wide vitals table (D1, C1, B11) and the admission
summary with the rule-based quality score (D3, D4, C2, B12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import OOR_LIMITS, VITALS
from ..functions import dq_score, hour_diff, missing_count

SUMMARY_AVGS = ["heart_rate", "systolic_bp", "spo2", "temperature_c", "respiratory_rate"]
SUMMARY_KEYS = ["hadm_id", "subject_id", "admission_type", "hospital_expire_flag", "los_hours"]
ROLLUP_COLUMNS = SUMMARY_KEYS + [
    "total_chart_rows", "total_missing_vitals", *[f"avg_{c}" for c in SUMMARY_AVGS],
    "hr_oor_count", "spo2_oor_count", "rr_oor_count", "first_chart_time", "last_chart_time"]
SUMMARY_COLUMNS = ROLLUP_COLUMNS + ["total_diagnoses", "invalid_icd_count", "raw_dq_score"]


def pivot_vitals(charts: DataFrame, keys=("hadm_id", "subject_id", "charttime")) -> DataFrame:
    """One row per time point, one column per vital (max of the readings).

    A single aggregate of six max(CASE) expressions: one shuffle on the keys,
    with a map-side partial aggregate, so a hot admission is pre-reduced
    before it moves (DataFrame.pivot would plan a second aggregate).
    """
    return charts.groupBy(*keys).agg(*[
        F.max(F.when(F.col("vital_name") == v, F.col("valuenum"))).alias(v) for v in VITALS])


def icu_vitals(charts: DataFrame, admissions: DataFrame) -> DataFrame:
    """mart_icu_vitals: pivoted readings left-joined to their admission.

    Readings without an admission are kept with null attributes.  The join
    strategy is the planner's: broadcast only when the measured admissions
    side is under spark.sql.autoBroadcastJoinThreshold, otherwise a
    sort-merge join whose skewed partitions AQE splits.
    """
    p = pivot_vitals(charts)
    a = admissions.select("hadm_id", "admittime", "los_hours", "admission_type",
                          "hospital_expire_flag")
    j = p.join(a, "hadm_id", "left")
    return j.select(
        "hadm_id", "subject_id", "charttime", "admittime", "los_hours",
        "admission_type", "hospital_expire_flag",
        hour_diff("admittime", "charttime").alias("hours_since_admit"),
        *VITALS,
        missing_count(VITALS).alias("missing_vitals_count"))


def _oor(col: str) -> F.Column:
    lo, hi = OOR_LIMITS[col]
    return F.sum(F.when((F.col(col) < lo) | (F.col(col) > hi), 1).otherwise(0))


def vital_rollup(vitals: DataFrame) -> DataFrame:
    """D3: one row per admission (and its attributes) over the wide rows."""
    return vitals.groupBy(*SUMMARY_KEYS).agg(
        F.count(F.lit(1)).alias("total_chart_rows"),
        F.sum("missing_vitals_count").alias("total_missing_vitals"),
        *[F.avg(c).alias(f"avg_{c}") for c in SUMMARY_AVGS],
        _oor("heart_rate").alias("hr_oor_count"),
        _oor("spo2").alias("spo2_oor_count"),
        _oor("respiratory_rate").alias("rr_oor_count"),
        F.min("charttime").alias("first_chart_time"),
        F.max("charttime").alias("last_chart_time"))


def diagnosis_rollup(diagnoses: DataFrame) -> DataFrame:
    """Codes and invalid codes per admission (aggregated before the join)."""
    return diagnoses.groupBy("hadm_id").agg(
        F.count(F.lit(1)).alias("total_diagnoses"),
        F.sum(F.when(~F.col("is_valid_icd"), 1).otherwise(0)).alias("invalid_icd_count"))


def patient_summary(vitals: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """mart_patient_summary: rollups joined on hadm_id, plus raw_dq_score.

    Both sides are aggregated to one row per admission first, so the join
    has no fan-out and no hot key.
    """
    return _with_diagnoses(vital_rollup(vitals), diagnoses)


def patient_summary_from_readings(charts: DataFrame, admissions: DataFrame,
                                  diagnoses: DataFrame) -> DataFrame:
    """mart_patient_summary straight from readings, aggregating before the
    admission join (same rows as patient_summary(icu_vitals(...), ...)).

    The wide rows are rolled up per (hadm_id, subject_id) first - a partial
    aggregate, so a hot admission shrinks to one row per map task - and only
    then joined to the admissions.  Admission rows sharing (hadm_id,
    attributes) are counted (``_mult``): a join would repeat every wide row
    that many times, so counts and sums are multiplied by it, while averages,
    minima and maxima are unchanged.  Exact, with no fan-out and no hot key
    in the join.
    """
    p = pivot_vitals(charts)
    oor = {c: F.when((F.col(c) < lo) | (F.col(c) > hi), 1).otherwise(0)
           for c, (lo, hi) in OOR_LIMITS.items()}
    pre = p.groupBy("hadm_id", "subject_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(missing_count(VITALS)).alias("_missing"),
        *[F.avg(c).alias(f"avg_{c}") for c in SUMMARY_AVGS],
        F.sum(oor["heart_rate"]).alias("_hr"), F.sum(oor["spo2"]).alias("_spo2"),
        F.sum(oor["respiratory_rate"]).alias("_rr"),
        F.min("charttime").alias("first_chart_time"), F.max("charttime").alias("last_chart_time"))
    adm = admissions.groupBy("hadm_id", "admission_type", "hospital_expire_flag", "los_hours") \
        .agg(F.count(F.lit(1)).alias("_mult"))
    j = pre.join(adm, "hadm_id", "left")
    mult = F.coalesce(F.col("_mult"), F.lit(1))
    v = j.select(*SUMMARY_KEYS,
                 (F.col("_rows") * mult).alias("total_chart_rows"),
                 (F.col("_missing") * mult).alias("total_missing_vitals"),
                 *[f"avg_{c}" for c in SUMMARY_AVGS],
                 (F.col("_hr") * mult).alias("hr_oor_count"),
                 (F.col("_spo2") * mult).alias("spo2_oor_count"),
                 (F.col("_rr") * mult).alias("rr_oor_count"),
                 "first_chart_time", "last_chart_time")
    return _with_diagnoses(v, diagnoses)


def _with_diagnoses(v: DataFrame, diagnoses: DataFrame) -> DataFrame:
    d = diagnosis_rollup(diagnoses)
    j = v.join(d, "hadm_id", "left")
    return j.select(
        *ROLLUP_COLUMNS,
        F.coalesce("total_diagnoses", F.lit(0)).cast("long").alias("total_diagnoses"),
        F.coalesce("invalid_icd_count", F.lit(0)).cast("long").alias("invalid_icd_count"),
        dq_score(F.col("total_missing_vitals"), F.col("total_chart_rows"),
                 F.col("hr_oor_count") + F.col("spo2_oor_count") + F.col("rr_oor_count"),
                 F.col("invalid_icd_count"), F.col("total_diagnoses")).alias("raw_dq_score"))
