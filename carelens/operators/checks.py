"""Column checks and the gate (J1-J4), dbt-style.

A rule is (model, column, test[, values]).  All tests of one table run in
one aggregate over it (unique needs its own group-by), and the results come
back as rows (model, column_name, test, failures), failures counted the way
dbt counts the rows its test query returns:
not_null - null rows; unique - values seen more than once (nulls ignored);
accepted_values - distinct values outside the list (nulls ignored).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ACCEPTED_ADMISSION_TYPE, ACCEPTED_GENDER, VITALS

# --- fixed values: the reference's column tests ----------------------------
RULES = [
    ("stg_patients", "subject_id", "not_null"),
    ("stg_patients", "subject_id", "unique"),
    ("stg_patients", "gender", "not_null"),
    ("stg_patients", "gender", "accepted_values", ACCEPTED_GENDER),
    ("stg_patients", "anchor_age", "not_null"),
    ("stg_admissions", "hadm_id", "not_null"),
    ("stg_admissions", "hadm_id", "unique"),
    ("stg_admissions", "subject_id", "not_null"),
    ("stg_admissions", "los_hours", "not_null"),
    ("stg_admissions", "admission_type", "accepted_values", ACCEPTED_ADMISSION_TYPE),
    ("stg_chartevents", "hadm_id", "not_null"),
    ("stg_chartevents", "vital_name", "not_null"),
    ("stg_chartevents", "vital_name", "accepted_values", VITALS),
    ("stg_diagnoses_icd", "hadm_id", "not_null"),
    ("stg_diagnoses_icd", "icd9_code", "not_null"),
    ("stg_diagnoses_icd", "is_valid_icd", "not_null"),
    ("mart_icu_vitals", "hadm_id", "not_null"),
    ("mart_icu_vitals", "charttime", "not_null"),
    ("mart_icu_vitals", "missing_vitals_count", "not_null"),
    ("mart_patient_summary", "hadm_id", "not_null"),
    ("mart_patient_summary", "hadm_id", "unique"),
]

RESULT_SCHEMA = "model string, column_name string, test string, failures bigint"


def _result(model: str, col: str, test: str, failures: F.Column) -> list:
    return [F.lit(model).alias("model"), F.lit(col).alias("column_name"),
            F.lit(test).alias("test"), failures.cast("long").alias("failures")]


def _table_checks(model: str, df: DataFrame, rules) -> list[DataFrame]:
    out = []
    simple = [r for r in rules if r[2] in ("not_null", "accepted_values")]
    if simple:
        aggs = []
        for i, r in enumerate(simple):
            c = F.col(r[1])
            if r[2] == "not_null":
                aggs.append(F.count_if(c.isNull()).alias(f"_f{i}"))
            else:
                aggs.append(F.count_distinct(F.when(~c.isin(list(r[3])), c)).alias(f"_f{i}"))
        wide = df.agg(*aggs)
        stack = F.explode(F.array(*[F.struct(*_result(model, r[1], r[2], F.col(f"_f{i}")))
                                    for i, r in enumerate(simple)]))
        out.append(wide.select(stack.alias("r")).select("r.*"))
    for r in rules:
        if r[2] == "unique":
            dup = (df.where(F.col(r[1]).isNotNull()).groupBy(r[1]).count()
                   .where(F.col("count") > 1))
            out.append(dup.agg(*_result(model, r[1], "unique", F.count(F.lit(1)))))
    return out


def run_checks(tables: dict[str, DataFrame], rules=RULES, tests=None) -> DataFrame:
    """J1-J3 over ``tables`` (name -> DataFrame); optionally only some tests."""
    parts = []
    for model, df in tables.items():
        rs = [r for r in rules if r[0] == model and (tests is None or r[2] in tests)]
        if rs:
            parts += _table_checks(model, df, rs)
    return reduce(lambda a, b: a.unionByName(b), parts)


class CheckFailed(RuntimeError):
    pass


def gate(results: DataFrame) -> DataFrame:
    """Stop the run when any test has failures.  The result has one row
    per rule (a fixed, small number), so it is safe to collect."""
    bad = [r.asDict() for r in results.where(F.col("failures") > 0).collect()]
    if bad:
        raise CheckFailed("column checks failed: " + "; ".join(
            f"{b['model']}.{b['column_name']} {b['test']}: {b['failures']}" for b in bad))
    return results
