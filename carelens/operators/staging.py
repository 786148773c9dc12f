"""Staging: typed, cleaned views over the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ACCEPTED_GENDER, VALID_ICD9, VITALS
from ..functions import hour_diff, nan_to_null

# Codes (about 50 bytes each) up to which a code table is broadcast.
BROADCAST_CODES = 200_000


def with_load_time(df: DataFrame) -> DataFrame:
    """Add the _loaded_at stamp of materialised tables."""
    return df.withColumn("_loaded_at", F.current_timestamp())


def stage_patients(raw: DataFrame) -> DataFrame:
    # The gender filter runs before upper(): a lower-case 'f' is dropped.
    return (raw.where(F.col("subject_id").isNotNull() & F.col("gender").isin(ACCEPTED_GENDER))
            .select("subject_id", F.upper("gender").alias("gender"), "anchor_age", "anchor_year"))


def stage_admissions(raw: DataFrame) -> DataFrame:
    admit = F.col("admittime").cast("timestamp")
    disch = F.col("dischtime").cast("timestamp")
    return (raw.where(F.col("hadm_id").isNotNull() & F.col("subject_id").isNotNull()
                      & F.col("admittime").isNotNull() & F.col("dischtime").isNotNull()
                      & (disch >= admit))
            .select("hadm_id", "subject_id",
                    admit.alias("admittime"), disch.alias("dischtime"),
                    hour_diff(admit, disch).alias("los_hours"),
                    F.upper(F.trim("admission_type")).alias("admission_type"),
                    F.col("hospital_expire_flag").cast("int").alias("hospital_expire_flag")))


def stage_chartevents(raw: DataFrame) -> DataFrame:
    # isin + isNotNull are pushed into the Parquet scan when raw is a table.
    return (raw.where(F.col("hadm_id").isNotNull() & F.col("vital_name").isNotNull()
                      & F.col("vital_name").isin(VITALS))
            .select("hadm_id", "subject_id",
                    F.col("charttime").cast("timestamp").alias("charttime"),
                    "vital_name",
                    nan_to_null(F.col("valuenum").cast("double")).alias("valuenum")))


def stage_diagnoses(raw: DataFrame, codes=VALID_ICD9) -> DataFrame:
    """Diagnoses with ``is_valid_icd``: is the code in ``codes``, a fixed list (an
    IN-set, no join) or a table whose first column holds codes (``known_codes``)?"""
    code = F.upper(F.trim("icd9_code"))
    rows = raw.where(F.col("hadm_id").isNotNull() & F.col("icd9_code").isNotNull()).select(
        "hadm_id", "seq_num", code.alias("icd9_code"))
    if not isinstance(codes, DataFrame):
        return rows.withColumn("is_valid_icd", F.when(F.col("icd9_code").isin(list(codes)), True).otherwise(False))
    return known_codes(rows, codes)


def known_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``is_valid_icd``, the existence of a row's code in the code table (trimmed,
    upper case; repeats and nulls there do no harm).  The table is broadcast if it
    is counted to be small, else both sides meet by code, where one frequent code is
    split by the skew join."""
    own = codes.select(F.upper(F.trim(F.col(codes.columns[0]).cast("string"))).alias("_code")).where(
        "_code IS NOT NULL").distinct()
    # Counting stops at the bound, so a huge table is not read whole for it.
    if own.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES:
        own = F.broadcast(own)
    return rows.join(own, F.col("icd9_code") == F.col("_code"), "left").select(
        "hadm_id", "seq_num", "icd9_code", F.col("_code").isNotNull().alias("is_valid_icd"))


# Staging view -> how it is made, and from which raw table.
VIEWS = {"stg_patients": (stage_patients, "patients"), "stg_admissions": (stage_admissions, "admissions"),
         "stg_chartevents": (stage_chartevents, "chartevents"), "stg_diagnoses_icd": (stage_diagnoses, "diagnoses")}


def stage(raw, name: str) -> DataFrame:
    """One staging view; only its raw table is touched."""
    view, table = VIEWS[name]
    return view(getattr(raw, table))


def stage_all(raw) -> dict[str, DataFrame]:
    return {name: stage(raw, name) for name in VIEWS}
