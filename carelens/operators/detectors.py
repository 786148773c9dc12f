"""Failure detectors and the failure report.

J5/J6 are the mart's own rules as rows; J7-J9 are the README's promised
checks with our definitions (duplicates, gaps over 4 h, spikes over half a
vital's plausible range).  Order-dependent detectors avoid one window per
admission: a single hot admission may hold a third of all readings.  They
look back within range partitions and carry the last row of each range to
the next (``ranks.with_previous``), which gives exactly the plain lag() result.
The report groups the readings once: the copies are J7, the distinct rows
feed J9, and J8 takes its time points from the mart, which has each once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GAP_MINUTES, OOR_LIMITS, SPIKE_RANGE_SHARE, VITAL_RANGES, VITALS
from ..session import checkpoint_dir
from .ranks import with_previous

REPORT_COLUMNS = ["hadm_id", "charttime", "failure_type", "item", "value"]


def _long_vitals(vitals: DataFrame) -> DataFrame:
    return vitals.select("hadm_id", "charttime", F.explode(F.array(*[
        F.struct(F.lit(v).alias("vital_name"), F.col(v).alias("value")) for v in VITALS])).alias("x")) \
        .select("hadm_id", "charttime", "x.vital_name", "x.value")


def missing_and_out_of_range(vitals: DataFrame) -> DataFrame:
    """Per wide row, a missing vital or an out-of-range hr/spo2/rr."""
    lv = _long_vitals(vitals)
    oor = None
    for v, (lo, hi) in OOR_LIMITS.items():
        c = (F.col("vital_name") == v) & ((F.col("value") < lo) | (F.col("value") > hi))
        oor = c if oor is None else oor | c
    kind = F.when(F.col("value").isNull(), "missing_vital").when(oor, "out_of_range")
    return (lv.withColumn("failure_type", kind).where(F.col("failure_type").isNotNull())
            .select("hadm_id", "charttime", "failure_type", F.col("vital_name").alias("item"),
                    "value"))


def icd_mismatch(diagnoses: DataFrame) -> DataFrame:
    """Diagnosis rows whose code is not a valid ICD-9 code."""
    return diagnoses.where(~F.col("is_valid_icd")).select("hadm_id", "seq_num", "icd9_code")


def duplicate_readings(charts: DataFrame) -> DataFrame:
    """The same five columns more than once (partial aggregation first)."""
    return _copies(charts).where(F.col("copies") > 1)


def _copies(charts: DataFrame) -> DataFrame:
    keys = ["hadm_id", "subject_id", "charttime", "vital_name", "valuenum"]
    return charts.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def _minutes_between(a: F.Column, b: F.Column) -> F.Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(60_000_000.0)


def time_gaps(charts: DataFrame, minutes: float = GAP_MINUTES) -> DataFrame:
    """Consecutive distinct time points of an admission more than
    ``minutes`` apart: hadm_id, prev_charttime, charttime, gap_minutes.  Takes
    readings or any rows that have each time point at least once."""
    t = charts.where(F.col("charttime").isNotNull()).select("hadm_id", "charttime").distinct()
    gap = _minutes_between(F.col("prev_charttime"), F.col("charttime"))
    return with_previous(t, ["hadm_id"], ["charttime"], ["charttime"], gap > minutes).select(
        "hadm_id", "prev_charttime", "charttime", gap.alias("gap_minutes"))


def _spike_limit() -> F.Column:
    e = None
    for v in VITALS:
        lo, hi = VITAL_RANGES[v]
        val = F.lit(SPIKE_RANGE_SHARE * (hi - lo))
        e = F.when(F.col("vital_name") == v, val) if e is None else e.when(F.col("vital_name") == v, val)
    return e


def spikes(charts: DataFrame) -> DataFrame:
    """A non-null reading that jumps from the previous reading of the
    same vital (order: charttime, valuenum) by more than half the vital's
    plausible range: hadm_id, vital_name, prev_charttime, charttime,
    prev_value, valuenum, jump.

    Copies of a reading only pair with each other (jump 0), so readings are
    de-duplicated first - a partial aggregate that collapses any number of
    copies in the map tasks - with the same result as the plain lag()."""
    return _spikes(charts.select("hadm_id", "vital_name", "charttime", "valuenum").distinct())


def _spikes(readings: DataFrame) -> DataFrame:
    """Spikes of readings without copies."""
    r = readings.where(F.col("valuenum").isNotNull() & F.col("vital_name").isin(VITALS)
                       & F.col("charttime").isNotNull()).select("hadm_id", "vital_name", "charttime", "valuenum")
    jump = F.col("valuenum") - F.col("prev_valuenum")
    return with_previous(r, ["hadm_id", "vital_name"], ["charttime", "valuenum"], ["charttime", "valuenum"],
                         F.abs(jump) > _spike_limit()).select(
        "hadm_id", "vital_name", "prev_charttime", "charttime", F.col("prev_valuenum").alias("prev_value"),
        "valuenum", jump.alias("jump"))


def anomalous_rows(scores: DataFrame) -> DataFrame:
    """Flagged time points as report rows."""
    return scores.where(F.col("anomaly_flag") == 1).select(
        "hadm_id", "charttime", F.lit("anomaly").alias("failure_type"),
        F.lit(None).cast("string").alias("item"), F.col("reconstruction_error").alias("value"))


def failure_report(vitals: DataFrame, diagnoses: DataFrame, charts: DataFrame,
                   anomalies: DataFrame | None = None) -> DataFrame:
    """Every failure as (hadm_id, charttime, failure_type, item, value).
    ``charts`` are the readings that ``vitals`` was pivoted from; both are read once."""
    checkpoint_dir(charts.sparkSession)
    copies = _copies(charts).checkpoint()
    # A reading repeated under another subject is still one point of its vital.
    points = copies.select("hadm_id", "vital_name", "charttime", "valuenum").distinct()
    parts = [
        missing_and_out_of_range(vitals),
        icd_mismatch(diagnoses).select("hadm_id", F.lit(None).cast("timestamp").alias("charttime"),
                                       F.lit("invalid_icd").alias("failure_type"),
                                       F.col("icd9_code").alias("item"),
                                       F.lit(None).cast("double").alias("value")),
        copies.where(F.col("copies") > 1).select("hadm_id", "charttime", F.lit("duplicate").alias("failure_type"),
                                          F.col("vital_name").alias("item"),
                                          F.col("valuenum").alias("value")),
        time_gaps(vitals).select("hadm_id", "charttime", F.lit("time_gap").alias("failure_type"),
                                 F.lit(None).cast("string").alias("item"),
                                 F.col("gap_minutes").alias("value")),
        _spikes(points).select("hadm_id", "charttime", F.lit("spike").alias("failure_type"),
                              F.col("vital_name").alias("item"), F.col("jump").alias("value")),
    ]
    if anomalies is not None:
        parts.append(anomalous_rows(anomalies))
    return reduce(lambda a, b: a.unionByName(b), [p.select(*REPORT_COLUMNS) for p in parts])


def failure_counts(report: DataFrame) -> DataFrame:
    """J11 counts: rows and admissions per failure type."""
    return report.groupBy("failure_type").agg(F.count(F.lit(1)).alias("failures"),
                                              F.count_distinct("hadm_id").alias("admissions"))
