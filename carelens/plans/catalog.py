"""Registry of checked queries: name -> f(spark, sf_dir) -> DataFrame.

Each query starts from the test tables (customer, orders, lineitem), derives
the raw clinical tables and runs the operator over them whole.  The DuckDB
twin of each SQL-checkable query is in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FIXTURE_SALT
from ..functions import anon_id, round_avg
from ..operators import (anomaly, calibrate, checks, dashboard, detectors, explain, marts, review,
                         sketches, staging, trust)
from ..session import prepare, scratch_dir
from ..sources import store, tolerant
from ..sources.fixtures import fixture_run_log, ingested_raw, messy_chartevents
from .pipeline import Paths, train

_MARTS: dict = {}
_FITTED: dict = {}


class Ctx:
    """Frames of one query.  ``vitals``/``summary`` are built from the
    readings; ``vitals_t``/``summary_t`` are the materialised mart tables
    (written once per application and data folder, as the reference's marts
    are tables), which downstream operators read.  A raw table, staging view or
    mart that the query does not use is not built."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self.key = (spark.sparkContext.applicationId, sf_dir)
        self.raw = ingested_raw(spark, sf_dir)

    def stage(self, name: str) -> DataFrame:
        return staging.stage(self.raw, name)

    @property
    def stg(self) -> dict[str, DataFrame]:
        return staging.stage_all(self.raw)

    @property
    def charts(self) -> DataFrame:
        return self.stage("stg_chartevents")

    @property
    def vitals(self) -> DataFrame:
        return marts.icu_vitals(self.charts, self.stage("stg_admissions"))

    def _stored(self, name: str, make) -> DataFrame:
        """The rows of ``make()``, written once per application and data folder."""
        key = (name,) + self.key
        if key not in _MARTS:
            path = scratch_dir(self.spark, "carelens-marts") + "/" + name
            make().write.mode("overwrite").parquet(path)
            _MARTS[key] = path
        return self.spark.read.parquet(_MARTS[key])

    @property
    def vitals_t(self) -> DataFrame:
        return self._stored("mart_icu_vitals", lambda: self.vitals)

    @property
    def summary_t(self) -> DataFrame:
        # From the stored wide rows, as in the daily run; the same rows as ``summary``.
        return self._stored("mart_patient_summary", lambda: marts.patient_summary(
            self.vitals_t, self.stage("stg_diagnoses_icd")))

    def _marts(self) -> None:
        """Build both marts."""
        self.vitals_t, self.summary_t

    @property
    def summary(self) -> DataFrame:
        # Same rows as patient_summary(vitals, ...); aggregates before the
        # admission join, so one plan stays skew-proof.
        return marts.patient_summary_from_readings(self.charts, self.stage("stg_admissions"),
                                                   self.stage("stg_diagnoses_icd"))


def rounded_summary(df: DataFrame) -> DataFrame:
    return df.select(*[round_avg(c).alias(c) if c.startswith("avg_") else F.col(c)
                       for c in marts.SUMMARY_COLUMNS])


def q_anon_ids(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("raw_id"),
                    anon_id("c_custkey", FIXTURE_SALT).alias("anon_id"))


def _stg(name):
    def run(spark, sf_dir):
        return Ctx(spark, sf_dir).stage(name)
    return run


def q_mart_vitals(spark, sf_dir):
    return Ctx(spark, sf_dir).vitals


def q_mart_summary(spark, sf_dir):
    return rounded_summary(Ctx(spark, sf_dir).summary)


QUERIES = {
    "anon_ids": q_anon_ids,
    "stg_patients": _stg("stg_patients"),
    "stg_admissions": _stg("stg_admissions"),
    "stg_chartevents": _stg("stg_chartevents"),
    "stg_diagnoses": _stg("stg_diagnoses_icd"),
    "mart_vitals": q_mart_vitals,
    "mart_summary": q_mart_summary,
}


# --- anomaly preparation and the mean model -------------------------------


class ScoreCtx(Ctx):
    """Adds the fixed scores: the mean reconstruction model and
    trust_score = raw_dq_score."""

    @property
    def pivot(self):
        """Stored like the marts: the fits and the scoring read it, five to seven times a query."""
        return self._stored("scoring_pivot", lambda: anomaly.scoring_pivot(self.vitals_t))

    @property
    def train(self):
        return anomaly.train_matrix(self.pivot, self.medians)

    @property
    def medians(self):
        """Fitted once per application and data folder (fit, then score)."""
        k = ("medians",) + self.key
        if k not in _FITTED:
            _FITTED[k] = anomaly.column_medians(self.pivot)
        return _FITTED[k]

    @property
    def mean_model(self):
        k = ("mean_model",) + self.key
        if k not in _FITTED:
            _FITTED[k] = anomaly.MeanModel.fit(self.train)
        return _FITTED[k]

    @property
    def scores(self):
        return anomaly.score_pivot(self.pivot, self.mean_model, self.medians)

    @property
    def trust(self):
        return trust.fixed_trust(self.summary_t)

    @property
    def board(self):
        return dashboard.dashboard_summary(self.summary_t, self.trust)

    @property
    def flagged_ids(self):
        return self.trust.where(F.col("dq_flagged"))

    def tables(self):
        return {**self.stg, "mart_icu_vitals": self.vitals_t, "mart_patient_summary": self.summary_t}


def _rounded(df, cols, digits=6):
    return df.withColumns({c: round_avg(c, digits) for c in cols})


def _sc(fn):
    def run(spark, sf_dir):
        return fn(ScoreCtx(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


QUERIES.update({
    "clean_readings": _sc(lambda c: anomaly.clean_readings(c.charts)),
    "pivot_scoring": _sc(lambda c: anomaly.scoring_pivot(c.vitals_t)),
    "scaled_vitals": _sc(lambda c: anomaly.scale_vitals(c.pivot, keep=["hadm_id", "charttime"])),
    "column_medians": _sc(lambda c: anomaly.median_frame(c.pivot)),
    "imputed_vitals": _sc(lambda c: anomaly.impute(c.pivot, c.medians)),
    "shortest_column": _sc(lambda c: anomaly.shortest_column(c.charts)),
    "train_matrix": _sc(lambda c: c.train),
    "anomaly_threshold": _sc(lambda c: _rounded(anomaly.threshold_frame(
        c.train, c.mean_model), ["threshold", "mean_error"], 9)),
    "anomaly_flags_mean": _sc(lambda c: c.scores),
    "anomaly_rollup": _sc(lambda c: _rounded(anomaly.anomaly_rollup(c.scores), ["avg_recon_error"])),
    "scoring_summary": _sc(lambda c: _rounded(anomaly.scoring_summary(c.scores), ["flagged_share"])),
    "trust_features": _sc(lambda c: _rounded(trust.trust_features(c.summary_t, c.scores),
                                             ["avg_recon_error"])),
    "label_balance": _sc(lambda c: _rounded(trust.label_balance(
        trust.trust_features(c.summary_t, c.scores)), ["positive_share"])),
    "kpis": _sc(lambda c: _rounded(dashboard.kpis(c.board), [
        "flagged_share", "avg_trust_score", "avg_missing_vitals"])),
    "failures_by_type": _sc(lambda c: dashboard.failures_by_type(c.board)),
    "trust_histogram": _sc(lambda c: dashboard.trust_histogram(c.board)),
    "flagged_filter": _sc(lambda c: dashboard.flagged(c.board, ["Missing vitals", "Invalid ICD"])),
    "flagged_sorted": _sc(lambda c: dashboard.flagged(c.board)),
    "worklist": _sc(lambda c: review.worklist(c.trust)),
    "vitals_sample": _sc(lambda c: review.vitals_sample(c.charts, c.flagged_ids)),
    "record_context": _sc(lambda c: review.record_context(c.summary_t, c.flagged_ids)),
    "trust_verdict": _sc(lambda c: review.trust_verdict(c.trust)),
    "review_table": _sc(lambda c: review.review_table(c.summary_t, c.trust, c.charts)),
    "check_not_null": _sc(lambda c: checks.run_checks(c.tables(), tests=["not_null"])),
    "check_unique": _sc(lambda c: checks.run_checks(c.tables(), tests=["unique"])),
    "check_accepted": _sc(lambda c: checks.run_checks(c.tables(), tests=["accepted_values"])),
    "oor_detail": _sc(lambda c: detectors.missing_and_out_of_range(c.vitals_t)),
    "icd_mismatch": _sc(lambda c: detectors.icd_mismatch(c.stage("stg_diagnoses_icd"))),
    "dup_readings": _sc(lambda c: detectors.duplicate_readings(c.charts)),
    "time_gaps": _sc(lambda c: detectors.time_gaps(c.charts)),
    "spikes": _sc(lambda c: detectors.spikes(c.charts)),
    "failure_report": _sc(lambda c: detectors.failure_report(
        c.vitals_t, c.stage("stg_diagnoses_icd"), c.charts, c.scores)),
    "failure_counts": _sc(lambda c: detectors.failure_counts(detectors.failure_report(
        c.vitals_t, c.stage("stg_diagnoses_icd"), c.charts, c.scores))),
})


# --- model-backed queries (rows-only checks) ------------------------------


_MODELS: dict = {}


class ModelCtx(ScoreCtx):
    """Trains both models once per (application, data folder) and reuses
    them: training is the offline step, these queries are the scoring."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _MODELS:
            _MODELS[key] = train(spark, self.vitals_t, self.summary_t, Paths(scratch_dir(spark, "carelens-models")),
                                 pivot=self.pivot)
        self.models = _MODELS[key]

    @property
    def ae_scores(self):
        return anomaly.score_pivot(self.pivot, self.models.anomaly, self.models.medians)

    @property
    def features(self):
        return trust.trust_features(self.summary_t, self.ae_scores)

    @property
    def trust_scores(self):
        return trust.score_trust(self.features, self.models.trust_fit.model, self.models.trust_fit.calibration)

    def _score_tables(self) -> str:
        """ml_anomaly_scores and ml_trust_scores, written once (A5, A6):
        downstream readers use the tables, as in the reference."""
        k = ("scores",) + self.key
        if k not in _FITTED:
            root = self.models.trust_path.rsplit("/models/", 1)[0]
            self.ae_scores.write.mode("overwrite").parquet(root + "/ml_anomaly_scores")
            an = self.spark.read.parquet(root + "/ml_anomaly_scores")
            trust.score_trust(trust.trust_features(self.summary_t, an), self.models.trust_fit.model, self.models.trust_fit.calibration) \
                .write.mode("overwrite").parquet(root + "/ml_trust_scores")
            _FITTED[k] = root
        return _FITTED[k]

    @property
    def features_t(self):
        an = self.spark.read.parquet(self._score_tables() + "/ml_anomaly_scores")
        return trust.trust_features(self.summary_t, an)

    @property
    def trust_t(self):
        return self.spark.read.parquet(self._score_tables() + "/ml_trust_scores")

    @property
    def held_out(self):
        return trust.stratified_split(self.features_t).where("is_test")

    def shap(self, features):
        return explain.explain_trust(features, self.models.trust_fit.model, self.models.trust_path,
                                     calibration=self.models.trust_fit.calibration)


def _mc(fn):
    def run(spark, sf_dir):
        return fn(ModelCtx(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


def _reviewed(c):
    return review.apply_reviewer(review.review_table(c.summary_t, c.trust_t, c.charts))


QUERIES.update({
    "anomaly_scores": _mc(lambda c: c.ae_scores),
    "trust_scores": _mc(lambda c: c.trust_scores),
    "trust_metrics": _mc(lambda c: trust.classification_metrics(
        trust.predicted(c.held_out, c.models.trust_fit.model))),
    "shap_local": _mc(lambda c: c.shap(c.features_t)),
    "shap_global": _mc(lambda c: explain.global_importance(c.shap(c.held_out))),
    "reviewed": _mc(_reviewed),
})


def _split(c):
    return trust.stratified_split(trust.trust_features(c.summary_t, c.scores))


def _fixed_metrics(c):
    """The metrics of a score that any engine can compute: a low quality score predicts a problem."""
    rows = _split(c).where("is_test")
    return _rounded(trust.classification_metrics(rows.select(
        F.col("has_dq_problem").alias("label"), (-F.col("raw_dq_score")).alias("score"),
        (F.col("raw_dq_score") < trust.TRUST_FLAG_BELOW).cast("int").alias("predicted"))), ["value"], 9)


def q_recent_runs(spark, sf_dir):
    return store.latest_runs(fixture_run_log(prepare(spark), sf_dir))


QUERIES.update({
    "anomalous_rows": _sc(lambda c: detectors.anomalous_rows(c.scores)),
    "scatter_sample": _sc(lambda c: dashboard.scatter_sample(c.board)),
    "recent_runs": q_recent_runs,
    "trust_split": _sc(lambda c: _split(c).select("hadm_id", "has_dq_problem", "is_test")),
    "scaler_fit": _sc(lambda c: _rounded(trust.scaler_bounds(_split(c).where("NOT is_test")), ["lo", "hi"])),
    "trust_metrics_fixed": _sc(_fixed_metrics),
    "trust_summary": _sc(lambda c: _rounded(trust.score_summary(c.trust), ["flagged_share"])),
})


# --- mergeable quantiles and calibration ------------------------------------

# Medians and p95 of merged daily sketches are held against the true ranks.
SKETCH_SHARES, SKETCH_AUDIT = {"median": 0.5, "p95": 0.95}, 0.005


def _sketch_quantiles(c):
    scored = c.mean_model.error_columns(c.train, sketches.VITALS).select("hadm_id", "charttime", "reconstruction_error")
    rows = c.pivot.unionByName(scored, allowMissingColumns=True)
    names = [*sketches.VITALS, "reconstruction_error"]
    daily = sketches.daily_sketches(rows, names)
    merged = sketches.sketched_quantiles(daily, SKETCH_SHARES)
    return sketches.within_error(merged, rows, names, SKETCH_SHARES, SKETCH_AUDIT)


def _trust_calibrated(c):
    """The calibration of a score that any engine can compute: lost quality points."""
    rows = trust.trust_features(c.summary_t, c.scores).select(
        F.col("has_dq_problem").alias("label"), ((100 - F.col("raw_dq_score")) / 100).alias("score"))
    return _rounded(calibrate.calibration_table(rows), ["calibrated"], 9)


QUERIES.update({
    "sketch_quantiles": _sc(_sketch_quantiles),
    "trust_calibrated": _sc(_trust_calibrated),
})


def _messy(c):
    return tolerant.split_rows(messy_chartevents(c.raw.chartevents), "raw_chartevents")


def _rejects(c):
    field = lambda k: F.get_json_object("raw", f"$.{k}").alias(k)
    return _messy(c)[1].select("table_name", "reasons", field("hadm_id"), field("vital_name"))


def _primary_codes(c):
    """Codes that some admission has as its first diagnosis, with repeats."""
    return c.raw.diagnoses.where("seq_num = 1").select(F.concat(F.lit(" "), F.lower("icd9_code")).alias("code"))


QUERIES.update({
    "raw_rejects": _sc(_rejects),
    "tolerant_readings": _sc(lambda c: staging.stage_chartevents(_messy(c)[0])),
    "stg_diagnoses_by_table": _sc(lambda c: staging.stage_diagnoses(c.raw.diagnoses, _primary_codes(c))),
    "trust_split_bucket": _sc(lambda c: trust.bucket_split(trust.trust_features(c.summary_t, c.scores)).select(
        "hadm_id", "has_dq_problem", "is_test")),
})
