"""Declared schemas of the four raw tables (checked on load)."""

from pyspark.sql import types as T

RAW_PATIENTS = T.StructType([
    T.StructField("subject_id", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("anchor_age", T.IntegerType()),
    T.StructField("anchor_year", T.IntegerType()),
])

RAW_ADMISSIONS = T.StructType([
    T.StructField("hadm_id", T.StringType()),
    T.StructField("subject_id", T.StringType()),
    T.StructField("admittime", T.TimestampType()),
    T.StructField("dischtime", T.TimestampType()),
    T.StructField("admission_type", T.StringType()),
    T.StructField("hospital_expire_flag", T.IntegerType()),
])

RAW_DIAGNOSES = T.StructType([
    T.StructField("hadm_id", T.StringType()),
    T.StructField("seq_num", T.IntegerType()),
    T.StructField("icd9_code", T.StringType()),
])

RAW_CHARTEVENTS = T.StructType([
    T.StructField("hadm_id", T.StringType()),
    T.StructField("subject_id", T.StringType()),
    T.StructField("charttime", T.TimestampType()),
    T.StructField("vital_name", T.StringType()),
    T.StructField("valuenum", T.DoubleType()),
])

RAW_SCHEMAS = {
    "raw_patients": RAW_PATIENTS,
    "raw_admissions": RAW_ADMISSIONS,
    "raw_diagnoses_icd": RAW_DIAGNOSES,
    "raw_chartevents": RAW_CHARTEVENTS,
}


def conform(df, schema: T.StructType):
    """Select and cast a frame to a declared schema; fail on a missing column."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
