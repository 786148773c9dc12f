"""The daily run as one Spark application (the reference's six-task chain):

  load raw -> staging -> marts (materialised) -> column checks + gate ->
  anomaly scoring -> trust scoring -> review table -> reviewer

Marts and score tables are written as new versions of their tables, which later
steps read back, so lineage is cut at every materialised table and a lost
executor only recomputes from the last table.  Versions are published when they
are whole - the marts when the gate has passed them as well - so readers never
see a table that is missing, half written or bad.  Training is separate (``train``), as
in the reference, where the daily run only scores.
"""

from __future__ import annotations

import os
import uuid
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..constants import GBT_DEPTH, GBT_RATE, GBT_SUBSAMPLE, GBT_TREES, PCA_COMPONENTS, REVIEW_TOP_N, SEED, VITALS
from ..operators import anomaly, checks, detectors, explain, reconstruct, review, sketches, staging, trust
from ..operators import marts as M
from ..session import checkpoint_dir, prepare
from ..sources import store


@dataclass
class Paths:
    root: str

    @property
    def trust_model(self):
        return os.path.join(self.root, "models", "trust")

    @property
    def anomaly_model(self):
        return os.path.join(self.root, "models", "anomaly")

    @property
    def sketches(self):
        return os.path.join(self.root, "daily_sketches")

    @property
    def runs(self):
        return os.path.join(self.root, "run_metrics")


def default_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "carelens")


@dataclass
class Models:
    anomaly: object
    medians: dict
    trust_fit: object
    trust_path: str
    metrics: dict = field(default_factory=dict)
    seconds: dict = field(default_factory=dict)


CHECKED = ("stg_patients", "stg_admissions", "stg_chartevents", "stg_diagnoses_icd", "mart_icu_vitals", "mart_patient_summary")


def build_marts(spark: SparkSession, raw, buckets: int | None = None, rules=checks.RULES) -> dict[str, DataFrame]:
    """Staging views and the two mart tables: written as a new version, checked
    there, and published together only if no column test fails (J4); otherwise
    CheckFailed is raised and readers keep the tables they have.  With ``buckets``,
    the summary (one row per admission) is bucketed by hadm_id like the trust scores,
    so their joins need no shuffle; choose it by the data (about 128 MB each)."""
    stg = staging.stage_all(raw)
    with store.Release(spark) as release:
        vitals = release.write(staging.with_load_time(M.icu_vitals(stg["stg_chartevents"], stg["stg_admissions"])),
                               "mart_icu_vitals").drop("_loaded_at")
        summary = release.write(staging.with_load_time(M.patient_summary(vitals, stg["stg_diagnoses_icd"])),
                                "mart_patient_summary", bucket_by="hadm_id", buckets=buckets).drop("_loaded_at")
        t = {**stg, "mart_icu_vitals": vitals, "mart_patient_summary": summary}
        results = checks.gate(checks.run_checks({k: t[k] for k in CHECKED}, rules))
        release.publish()
    return {**t, "check_results": results}


def train(spark: SparkSession, vitals: DataFrame, summary: DataFrame, paths: Paths,
          trees: int = GBT_TREES, pivot: DataFrame | None = None) -> Models:
    """Fit the reconstruction model (I3), then the trust model (I9) on
    features that include its scores; save both and log the runs.  The scoring
    pivot of ``vitals`` is stored for the fits, which read it often, unless it is given."""
    import time
    prepare(spark)
    t0 = time.time()
    with store.logged_run(spark, paths.runs, f"reconstruction-train-{uuid.uuid4().hex[:8]}",
                          {"components": PCA_COMPONENTS}) as log:
        if pivot is None:
            stored = os.path.join(paths.root, "train_scoring_pivot")
            anomaly.scoring_pivot(vitals).write.mode("overwrite").parquet(stored)
            pivot = spark.read.parquet(stored)
        medians = anomaly.column_medians(pivot)
        ae = reconstruct.PcaModel.fit(anomaly.train_matrix(pivot, medians))
        store.save_anomaly_model(spark, ae, paths.anomaly_model)
        log.update(train_loss=ae.mean_error, anomaly_threshold_p95=ae.threshold, mean_recon_error=ae.mean_error)
    t1 = time.time()
    # Score once into a file the trust model then reads (the reference trains
    # the trust model on the stored anomaly scores).
    scored = os.path.join(paths.root, "train_anomaly_scores")
    anomaly.score_pivot(pivot, ae, medians).write.mode("overwrite").parquet(scored)
    feats = trust.trust_features(summary, spark.read.parquet(scored))
    t2 = time.time()
    with store.logged_run(spark, paths.runs, f"trust-scorer-train-{uuid.uuid4().hex[:8]}", {
            "n_estimators": trees, "max_depth": GBT_DEPTH, "learning_rate": GBT_RATE,
            "subsample": GBT_SUBSAMPLE, "random_state": SEED}) as log:
        fit = trust.fit_trust(feats, trees=trees)
        t3 = time.time()
        store.save_trust_model(fit.model, paths.trust_model, fit.calibration)
        log.update({**fit.metrics, **fit.calibration_errors, "train_loss": fit.loss_by_round})
        held_out, fit.held_out = fit.held_out, None   # split once; its checkpoint is not kept
        shap = explain.global_importance(explain.explain_trust(held_out, fit.model, paths.trust_model))
        log.update({f"shap_{r.feature}": r.importance for r in shap.collect()})
    return Models(ae, medians, fit, paths.trust_model, fit.metrics,
                  {"fit_reconstruction": round(t1 - t0, 3), "score_for_training": round(t2 - t1, 3),
                   "fit_trust": round(t3 - t2, 3)})


def run_pipeline(spark: SparkSession, raw, root: str | None = None, models: Models | None = None,
                 top_n: int = REVIEW_TOP_N, reviewer=review.rule_reviewer,
                 buckets: int | None = None, trees: int = GBT_TREES) -> dict[str, DataFrame]:
    """The daily run.  Raises checks.CheckFailed when a column test fails.
    ``buckets`` buckets the per-admission tables (see build_marts).
    ``models`` None trains both first, on the marts of this run.
    ``raw`` None scores the raw tables already stored; models without an
    anomaly model score trust without anomaly features."""
    prepare(spark)
    paths = Paths(root or default_root(spark))
    if raw is not None:
        store.load_raw_tables(spark, raw.as_dict())
    t = build_marts(spark, store.read_raw(spark), buckets)
    charts, summary = t["stg_chartevents"], t["mart_patient_summary"]
    if models is None:
        models = train(spark, t["mart_icu_vitals"], summary, paths, trees=trees)
    scores = None
    with store.Release(spark) as release:
        if models.anomaly is not None:
            # Missing vitals take the medians of the rows being scored.
            scores = release.write(anomaly.score_anomalies(t["mart_icu_vitals"], models.anomaly), "ml_anomaly_scores")
        feats = trust.trust_features(summary, scores)
        tr = release.write(trust.score_trust(feats, models.trust_fit.model, models.trust_fit.calibration), "ml_trust_scores",
                           bucket_by="hadm_id", buckets=buckets)
        release.publish()
    if scores is not None:
        sketches.store_daily(sketches.daily_sketches(scores, [*VITALS, "reconstruction_error"]), paths.sketches)
    table = review.review_table(summary, tr, charts, top_n)
    reviewed = review_step(spark, table, reviewer)
    report = detectors.failure_report(t["mart_icu_vitals"], t["stg_diagnoses_icd"], charts, scores)
    return {**t, "ml_anomaly_scores": scores, "ml_trust_scores": tr,
            "trust_summary": trust.score_summary(tr),
            "review_table": table, "reviewed": reviewed, "failure_counts": detectors.failure_counts(report)}


def review_step(spark: SparkSession, table: DataFrame, reviewer=review.rule_reviewer) -> DataFrame | None:
    """The reviewer's answers as the table ``ml_reviews``.  A review that fails is
    a warning and None: the scores of the run stand without it."""
    try:
        return store.save_published(review.apply_reviewer(table, reviewer), "ml_reviews")
    except Exception as e:  # noqa: BLE001 - whatever the reviewer needs may be missing
        warnings.warn(f"review failed: {e}", RuntimeWarning)
        return None


def train_only(spark: SparkSession, raw, root: str | None = None, trees: int = GBT_TREES) -> Models:
    """Marts, then both fits; scores nothing for the readers."""
    prepare(spark)
    if raw is not None:
        store.load_raw_tables(spark, raw.as_dict())
    t = build_marts(spark, store.read_raw(spark))
    return train(spark, t["mart_icu_vitals"], t["mart_patient_summary"], Paths(root or default_root(spark)), trees)


def explain_scores(spark: SparkSession, root: str | None = None) -> DataFrame:
    """SHAP values of every admission of the stored tables under the saved
    trust model, written as ``ml_trust_explanations``."""
    prepare(spark)
    path = Paths(root or default_root(spark)).trust_model
    scores = spark.table("ml_anomaly_scores") if store.table_exists(spark, "ml_anomaly_scores") else None
    feats = trust.trust_features(spark.table("mart_patient_summary"), scores)
    return store.save_published(explain.explain_trust(feats, store.load_trust_model(path), path,
                                                      calibration=store.load_calibration(spark, path)), "ml_trust_explanations")
