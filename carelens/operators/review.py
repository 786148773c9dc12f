"""Review of the least trusted admissions.

The reference looked up one admission at a time (three queries per
admission, an agent loop on the driver).  Here every piece is set-based:
the worklist is a top-N, contexts and samples are joins and windows over the
whole worklist, and the reviewer runs on executors.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import REVIEW_TOP_N, SAMPLE_READINGS
from ..functions import fmt_num, text_or

TS_TEXT = "yyyy-MM-dd HH:mm:ss"


def worklist(trust: DataFrame, top_n: int = REVIEW_TOP_N) -> DataFrame:
    """the N least trusted flagged admissions (ties by hadm_id), ranked.
    The limit is the feature: a per-task top-N, then one merge of N rows
    per task."""
    top = (trust.where(F.col("dq_flagged") == F.lit(True))
           .orderBy("trust_score", "hadm_id").limit(top_n))
    # The window sees at most top_n rows.
    return top.select("hadm_id", "trust_score", F.row_number().over(
        Window.orderBy("trust_score", "hadm_id")).alias("review_rank"))


def vitals_sample(charts: DataFrame, ids: DataFrame, n: int = SAMPLE_READINGS) -> DataFrame:
    """First n readings by time of each admission in ``ids``.

    Semi-join, then row_number() <= n per admission; Catalyst's window group
    limit keeps n rows per admission in each map task before the shuffle,
    so one huge admission cannot flood a task.
    """
    sel = charts.join(ids.select("hadm_id"), "hadm_id", "left_semi")
    w = Window.partitionBy("hadm_id").orderBy(
        F.col("charttime").asc(), F.col("vital_name").asc(), F.col("valuenum").asc_nulls_first())
    return (sel.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
            .select("hadm_id", "rn", "charttime", "vital_name", "valuenum"))


def sample_text(sample: DataFrame) -> DataFrame:
    """One text block per admission: 'time vital value' lines in order.
    Each group holds at most n rows, so collect_list is bounded."""
    line = F.concat_ws(" ", F.date_format("charttime", TS_TEXT), F.col("vital_name"),
                       F.coalesce(F.col("valuenum").cast("string"), F.lit("NaN")))
    return (sample.groupBy("hadm_id")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("rn"), line.alias("line")))).alias("_l"))
            .select("hadm_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
                    .alias("vitals_sample")))


def _context_text() -> F.Column:
    return F.concat(
        F.lit("Admission "), F.col("hadm_id"),
        F.lit(": type="), text_or("admission_type"),
        F.lit(", LOS="), fmt_num("los_hours", 0),
        F.lit("h, trust="), fmt_num("trust_score", 1),
        F.lit("/100, dq_score="), fmt_num("raw_dq_score", 1),
        F.lit("/100 | missing_vitals="), fmt_num("total_missing_vitals", 0),
        F.lit("/"), fmt_num("total_chart_rows", 0),
        F.lit(", hr_oor="), fmt_num("hr_oor_count", 0),
        F.lit(", spo2_oor="), fmt_num("spo2_oor_count", 0),
        F.lit(", invalid_icd="), fmt_num("invalid_icd_count", 0),
        F.lit("/"), fmt_num("total_diagnoses", 0))


def _verdict_text(flagged: F.Column) -> F.Column:
    return F.concat(F.lit("Trust score: "), fmt_num("trust_score", 1), F.lit("/100 ("),
                    F.when(flagged, F.lit("FLAGGED")).otherwise(F.lit("CLEAN")), F.lit(")"))


def _none_found(text: str) -> F.Column:
    return F.concat(F.lit(text), F.col("hadm_id"))


# The texts of a missing part, before the admission's id.
NO_RECORD = "No record found for hadm_id="
NO_VITALS = "No vitals found for hadm_id="
NO_SCORE = "No trust score found for "


def record_context(summary: DataFrame, trust: DataFrame) -> DataFrame:
    """K1 (+ C4): one line of context per admission in ``trust``; an admission
    without a summary row is named as not found."""
    s = trust.select("hadm_id", "trust_score").join(summary.withColumn("_known", F.lit(True)), "hadm_id", "left")
    return s.select("hadm_id", F.when(F.col("_known"), _context_text())
                    .otherwise(_none_found(NO_RECORD)).alias("record_context"))


def trust_verdict(trust: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """K3: 'Trust score: x/100 (FLAGGED|CLEAN)' per admission, of all in ``trust``
    or of the given ids, of which some may have no score."""
    if ids is not None:
        trust = ids.select("hadm_id").join(trust.withColumn("_known", F.lit(True)), "hadm_id", "left")
    else:
        trust = trust.withColumn("_known", F.lit(True))
    return trust.select("hadm_id", F.when(F.col("_known"), _verdict_text(F.col("dq_flagged")))
                        .otherwise(_none_found(NO_SCORE)).alias("trust_verdict"))


def review_table(summary: DataFrame, trust: DataFrame, charts: DataFrame,
                 top_n: int = REVIEW_TOP_N) -> DataFrame:
    """K4: the worklist with context, verdict, vitals sample and the request
    text, one row per admission - the complete input of a reviewer.  Context
    and verdict are columns of one join (every worklist row is flagged)."""
    wl = worklist(trust, top_n)
    smp = sample_text(vitals_sample(charts, wl))
    rows = wl.join(summary.withColumn("_known", F.lit(True)), "hadm_id", "left").join(smp, "hadm_id", "left")
    return rows.select(
        "review_rank", "hadm_id", "trust_score",
        F.when(F.col("_known"), _context_text()).otherwise(_none_found(NO_RECORD)).alias("record_context"),
        _verdict_text(F.lit(True)).alias("trust_verdict"),
        F.coalesce("vitals_sample", _none_found(NO_VITALS)).alias("vitals_sample"),
        F.concat(F.lit("Review admission "), F.col("hadm_id"),
                 F.lit(" and provide repair recommendations.")).alias("request"))


def rule_reviewer(row: dict) -> str:
    """A deterministic reviewer: names the failure types in the context.
    Output shape: '[failure types] | [significance] | [repair action]'."""
    ctx = row.get("record_context") or ""
    found = []
    for key, label in (("missing_vitals=", "missing vitals"), ("hr_oor=", "heart rate out of range"),
                       ("spo2_oor=", "SpO2 out of range"), ("invalid_icd=", "invalid ICD-9 codes")):
        i = ctx.find(key)
        if i >= 0:
            num = ctx[i + len(key):].split("/")[0].split(",")[0].strip()
            if num not in ("0", "nan", ""):
                found.append(label)
    if not found:
        return "none | no rule-based failure | no action"
    return (", ".join(found) + " | readings or codes cannot be trusted as recorded"
            + " | re-measure or re-code the affected records")


def apply_reviewer(review: DataFrame, fn: Callable[[dict], str] = rule_reviewer) -> DataFrame:
    """K5: run ``fn`` on every review row on the executors.  An exception
    becomes 'Error: ...' in that row's output; the other rows are kept."""
    from ..session import ship_package
    ship_package(review.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                try:
                    out.append(str(fn(rec)))
                except Exception as e:  # noqa: BLE001 - reviewer errors are data
                    out.append(f"Error: {e}")
            yield pd.DataFrame({"hadm_id": pdf["hadm_id"], "output": out})
    return review.mapInPandas(run, "hadm_id string, output string")
