"""Quarantined values, code tables and the split without a shuffle."""

from pyspark.sql import functions as F

import pytest

from carelens.operators import staging, trust
from carelens.plans.catalog import ScoreCtx
from carelens.sources import store, tolerant
from carelens.sources.fixtures import fixture_raw
from settings import SF_SMALL


def test_bad_values_are_quarantined_with_reasons(spark):
    rows = spark.createDataFrame([("a", "s", "2024-01-01 10:00:00", "spo2", "97.5"), ("b", "s", "soon", "spo2", "97"),
                                  ("c", "s", None, None, None), ("d", "s", "2024-13-01", "spo2", "x"), ("e", "s", "2024-01-02", "", " 5 ")],
                                 "hadm_id string, subject_id string, charttime string, vital_name string, valuenum string")
    with pytest.raises(Exception):
        store.conform(rows, store.RAW_SCHEMAS["raw_chartevents"]).collect()   # the strict load fails the job
    good, bad = tolerant.split_rows(rows, "raw_chartevents")
    assert [(r.hadm_id, r.valuenum) for r in good.orderBy("hadm_id").collect()] == [("a", 97.5), ("c", None), ("e", 5.0)]
    got = {r.raw.split('"')[3]: r.reasons for r in bad.collect()}
    assert got == {"b": "charttime:not_timestamp", "d": "charttime:not_timestamp,valuenum:not_double"}
    with pytest.raises(ValueError):
        tolerant.split_rows(rows.drop("valuenum"), "raw_chartevents")
    assert "Exchange" not in good._jdf.queryExecution().executedPlan().toString()


def test_good_rows_load_as_strictly(spark):
    raw = fixture_raw(spark, SF_SMALL).as_dict()
    store.load_raw_tables(spark, raw)
    strict = spark.table("raw_admissions").orderBy("hadm_id").collect()
    tolerant.load_tolerant(spark, raw)
    assert spark.table(tolerant.REJECTS).count() == 0
    assert spark.table("raw_admissions").orderBy("hadm_id").collect() == strict


def test_a_large_code_table_equals_the_list(spark, monkeypatch):
    rows = fixture_raw(spark, SF_SMALL).diagnoses
    many = spark.range(100_000).select(F.concat(F.lit("x"), F.col("id") % 60_000).alias("code"))
    codes = many.union(spark.createDataFrame([(f" {c.lower()} ",) for c in staging.VALID_ICD9 * 2] + [(None,)], "code string"))
    want = sorted(staging.stage_diagnoses(rows).collect())
    small = staging.stage_diagnoses(rows, codes)
    assert sorted(small.collect()) == want and any(not r.is_valid_icd for r in want)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(staging, "BROADCAST_CODES", 10)
    assert sorted(staging.stage_diagnoses(rows, codes).collect()) == want
    assert not any(r.is_valid_icd for r in staging.stage_diagnoses(rows, codes.limit(0)).collect())


def test_bucket_split_adds_no_exchange(spark):
    feats = trust.trust_features(ScoreCtx(spark, SF_SMALL).summary_t)
    split = trust.bucket_split(feats)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert plan(split) == plan(feats)
    assert .1 < split.agg(F.avg(F.col("is_test").cast("int"))).first()[0] < .3
