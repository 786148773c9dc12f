"""The four raw clinical tables, derived deterministically from the test
tables customer, orders and lineitem (FIXTURES.md, section 2).

The same expressions are written in DuckDB SQL in ``plans/oracle.py``, so the
Spark query and the oracle start from equal inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FIXTURE_SALT, VALID_ICD9, VITALS
from ..functions import add_minutes, anon_id
from ..session import prepare
from .schemas import (RAW_ADMISSIONS, RAW_CHARTEVENTS, RAW_DIAGNOSES,
                      RAW_PATIENTS, RAW_SCHEMAS, conform)

# --- fixed values of the fixture mapping ----------------------------------
FIXTURE_LO = [40.0, 60.0, 30.0, 70.0, 35.0, 8.0]
FIXTURE_SPAN = [140.0, 160.0, 100.0, 30.0, 5.5, 32.0]
HADM_OFFSET = 100000


@dataclass
class Raw:
    patients: DataFrame
    admissions: DataFrame
    diagnoses: DataFrame
    chartevents: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {"raw_patients": self.patients, "raw_admissions": self.admissions,
                "raw_diagnoses_icd": self.diagnoses, "raw_chartevents": self.chartevents}


def _pick(values, idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_patients(spark, sf_dir, salt=FIXTURE_SALT) -> DataFrame:
    k = F.col("c_custkey")
    df = _read(spark, sf_dir, "customer").select(
        anon_id(k, salt).alias("subject_id"),
        F.when(k % 20 == 19, "f").when(k % 25 == 24, "U")
         .when(k % 2 == 0, "M").otherwise("F").alias("gender"),
        (F.lit(18) + k % 78).alias("anchor_age"),
        (F.lit(2100) + k % 81).alias("anchor_year"))
    return conform(df, RAW_PATIENTS)


def _admissions_with_key(spark, sf_dir, salt=FIXTURE_SALT) -> DataFrame:
    k = F.col("o_orderkey")
    admit = add_minutes(F.col("o_orderdate").cast("timestamp"), k % 1440)
    stay = F.when(k % 100 == 99, F.lit(-300)).otherwise(F.lit(120) + (k * 7919) % 43080)
    return (_read(spark, sf_dir, "orders")
            .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
            .select(
                anon_id(k + HADM_OFFSET, salt).alias("hadm_id"),
                anon_id(F.col("o_custkey"), salt).alias("subject_id"),
                admit.alias("admittime"),
                add_minutes(admit, stay).alias("dischtime"),
                F.when(F.col("o_orderpriority") == "1-URGENT", " urgent ")
                 .when(F.col("o_orderpriority") == "5-LOW", "ELECTIVE")
                 .otherwise("Emergency").alias("admission_type"),
                F.when(k % 10 == 0, 1).otherwise(0).cast("int").alias("hospital_expire_flag"),
                k.alias("o_orderkey")))


def raw_admissions(spark, sf_dir, salt=FIXTURE_SALT) -> DataFrame:
    return conform(_admissions_with_key(spark, sf_dir, salt), RAW_ADMISSIONS)


def raw_diagnoses(spark, sf_dir, salt=FIXTURE_SALT) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    df = li.where(F.col("l_orderkey") % 40 != 1).select(
        anon_id(F.col("l_orderkey") + HADM_OFFSET, salt).alias("hadm_id"),
        F.col("l_linenumber").alias("seq_num"),
        F.when(F.col("l_partkey") % 33 == 0, "INVALID")
         .otherwise(_pick(VALID_ICD9, F.col("l_suppkey") % 10 + 1)).alias("icd9_code"))
    return conform(df, RAW_DIAGNOSES)


def raw_chartevents(spark, sf_dir, salt=FIXTURE_SALT) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    # Some readings come twice; they are added before the join, which then runs once.
    li = li.unionByName(li.where(F.col("l_partkey") % 50 == 7))
    adm = _admissions_with_key(spark, sf_dir, salt).select(
        "o_orderkey", "hadm_id", "subject_id", "admittime")
    # Equi-join on the order key; the planner picks broadcast or shuffle by
    # the measured size of the admissions side.
    j = li.join(adm, li.l_orderkey == adm.o_orderkey, "inner")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    idx = s % 6 + 1
    offset = (F.col("l_linenumber") / F.lit(2)).cast("long") * 60 \
        + F.when(p % 50 == 3, F.lit(300) + s * 11).otherwise(F.lit(0))
    value = (_pick(FIXTURE_LO, idx) + _pick(FIXTURE_SPAN, idx) * F.col("l_quantity") / F.lit(50.0)) \
        * F.when(p % 33 == 1, F.lit(2.0) + (p % 5) * F.lit(0.5)).otherwise(F.lit(1.0))
    df = j.select(
        "hadm_id", "subject_id",
        add_minutes(F.col("admittime"), offset).alias("charttime"),
        F.when(s % 50 == 0, "glucose").otherwise(_pick(VITALS, idx)).alias("vital_name"),
        F.when(p % 20 == 0, F.lit(None).cast("double")).otherwise(value).alias("valuenum"))
    return conform(df, RAW_CHARTEVENTS)


def fixture_raw(spark: SparkSession, sf_dir: str, salt: str = FIXTURE_SALT) -> Raw:
    """All four raw tables from a folder of test Parquet files (lazy plans)."""
    prepare(spark)
    return Raw(raw_patients(spark, sf_dir, salt), raw_admissions(spark, sf_dir, salt),
               raw_diagnoses(spark, sf_dir, salt), raw_chartevents(spark, sf_dir, salt))


_INGESTED: dict = {}


class Ingested(Raw):
    """The raw tables as scans of Parquet files under the shared checkpoint folder;
    each is derived and written when it is first used, once per application."""

    def __init__(self, spark: SparkSession, sf_dir: str, salt: str):
        self._spark, self._sf_dir, self._salt = spark, sf_dir, salt

    def _table(self, name: str, derive) -> DataFrame:
        import os

        from ..session import scratch_dir
        key = (self._spark.sparkContext.applicationId, os.path.abspath(self._sf_dir), self._salt, name)
        if key not in _INGESTED:
            path = os.path.join(scratch_dir(self._spark, "carelens-raw"), name)
            derive(self._spark, self._sf_dir, self._salt).write.mode("overwrite").parquet(path)
            _INGESTED[key] = path
        return self._spark.read.schema(RAW_SCHEMAS[name]).parquet(_INGESTED[key])

    @property
    def patients(self) -> DataFrame:
        return self._table("raw_patients", raw_patients)

    @property
    def admissions(self) -> DataFrame:
        return self._table("raw_admissions", raw_admissions)

    @property
    def diagnoses(self) -> DataFrame:
        return self._table("raw_diagnoses_icd", raw_diagnoses)

    @property
    def chartevents(self) -> DataFrame:
        return self._table("raw_chartevents", raw_chartevents)


def ingested_raw(spark: SparkSession, sf_dir: str, salt: str = FIXTURE_SALT) -> Raw:
    """Ingest (A1): derive the raw tables that are used once per application and write
    them as Parquet under the shared checkpoint folder; return scans of them.

    This is the reference's ingest -> table step.  Later queries scan plain
    columns, so their filters reach the Parquet reader and their plans stay
    small; the files survive executor loss.
    """
    return Ingested(prepare(spark), sf_dir, salt)


def messy_chartevents(charts: DataFrame) -> DataFrame:
    """Readings as text, some of them malformed (by digits of hadm_id), as a file of
    an unchecked source would bring them."""
    digit = lambda i: F.substring("hadm_id", i, 1)
    return charts.select(
        "hadm_id", "subject_id",
        F.when(digit(2) == "f", F.lit("yesterday")).otherwise(F.col("charttime").cast("string")).alias("charttime"), "vital_name",
        F.when((digit(1) == "0") & F.col("valuenum").isNotNull(), F.lit("n/a")).otherwise(F.col("valuenum").cast("string")).alias("valuenum"))


RUN_EVENTS = 40


def fixture_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log made of the test table ``events``: every RUN_EVENTS events are a run."""
    from .store import RUN_COLUMNS
    i = F.col("event_id")
    return _read(spark, sf_dir, "events").where("value IS NOT NULL").select(
        F.concat(F.lit("run-"), F.floor(i / RUN_EVENTS)).alias("run"),
        _pick([*RUN_COLUMNS, "param.n_estimators"], i % 4 + 1).alias("name"), "value",
        (F.floor(i / 4) % 10).cast("int").alias("step"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("FINISHED").alias("status"))
