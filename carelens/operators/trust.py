"""Trust scoring of admissions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (GBT_DEPTH, GBT_RATE, GBT_SUBSAMPLE, GBT_TREES,
                         LABEL_ICD_SHARE, LABEL_MAX_ANOMALY_FLAGS, SEED,
                         TEST_BUCKETS, TRUST_FEATURES, TRUST_FLAG_BELOW)
from .anomaly import anomaly_rollup
from .calibrate import Calibration, calibration_error
from .ranks import first_share, running_totals

FEATURE_BASE = ["hadm_id", "total_missing_vitals", "total_chart_rows", "hr_oor_count",
                "spo2_oor_count", "rr_oor_count", "invalid_icd_count", "raw_dq_score", "los_hours"]


def trust_features(summary: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Nine features, the label has_dq_problem and the key.

    With anomaly scores (C3) their per-admission rollup is joined - it is
    aggregated to one row per admission first - and more than two flagged
    time points also set the label (B13).  Without them the error is 0.0.
    """
    s = summary
    icd_share = F.col("invalid_icd_count").cast("double") / F.nullif(F.col("total_diagnoses"), F.lit(0))
    cond = (F.col("hr_oor_count") > 0) | (F.col("spo2_oor_count") > 0) | (icd_share > LABEL_ICD_SHARE)
    if anomalies is not None:
        a = anomaly_rollup(anomalies)
        s = s.join(a, "hadm_id", "left")
        err = F.coalesce(F.col("avg_recon_error"), F.lit(0.0))
        cond = cond | (F.coalesce(F.col("flagged_count"), F.lit(0)) > LABEL_MAX_ANOMALY_FLAGS)
    else:
        err = F.lit(0.0)
    # when(cond) treats a null condition as false: null -> 0, like CASE WHEN.
    return s.select(*FEATURE_BASE, err.alias("avg_recon_error"),
                    F.when(cond, 1).otherwise(0).alias("has_dq_problem"))


def label_balance(features: DataFrame) -> DataFrame:
    """Positives, their share, total."""
    return features.agg(F.sum("has_dq_problem").alias("positives"),
                        (F.sum("has_dq_problem") / F.count(F.lit(1))).alias("positive_share"),
                        F.count(F.lit(1)).alias("total"))


def fixed_trust(summary: DataFrame) -> DataFrame:
    """A trust table any engine can compute: trust_score = raw_dq_score."""
    return summary.select("hadm_id", F.col("raw_dq_score").alias("trust_score"),
                          (F.col("raw_dq_score") < TRUST_FLAG_BELOW).alias("dq_flagged"))


def stratified_split(features: DataFrame, label: str = "has_dq_problem", seed: int = SEED,
                     buckets: int = TEST_BUCKETS) -> DataFrame:
    """Add ``is_test``, true for one in ``buckets`` rows (rounded up) of each
    label: those with the smallest seeded SHA-256 of hadm_id.  A rare label is
    never missing from the hold-out; rows of one hadm_id and label stay together."""
    key = F.sha2(F.concat("hadm_id", F.lit(f":{seed}")), 256)
    return first_share(features.withColumn("_key", key), label, "_key", buckets).withColumnRenamed(
        "is_first", "is_test").drop("_key")


def bucket_split(features: DataFrame, seed: int = SEED, buckets: int = TEST_BUCKETS) -> DataFrame:
    """E3 without a shuffle: ``is_test`` for rows whose seeded SHA-256 of hadm_id falls
    into the first of ``buckets``, a column expression.  The share of each label is
    right on average only; ``stratified_split`` is the exact one."""
    key = F.conv(F.substring(F.sha2(F.concat("hadm_id", F.lit(f":{seed}")), 256), 1, 15), 16, 10).cast("bigint")
    return features.withColumn("is_test", F.coalesce(key % buckets == 0, F.lit(False)))


def scaler_bounds(features: DataFrame) -> DataFrame:
    """I8: (feature, lo, hi) that min-max scaling learns from these rows."""
    each = _filled(features).select(*TRUST_FEATURES).unpivot([], TRUST_FEATURES, "feature", "value")
    return each.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def classification_metrics(rows: DataFrame) -> DataFrame:
    """(metric, value) of rows (label 0/1, score, predicted 0/1): roc_auc from
    ranks of the score (ties count half; null if a label is absent), precision,
    recall and f1 of label 1 (0 where undefined), and the counts n and positives.
    Scores are counted first, so the ranks see one row per distinct score."""
    pos, hit = F.col("label") == 1, F.col("predicted") == 1
    each = rows.groupBy("score").agg(
        F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"), F.count_if(pos & hit).alias("tp"),
        F.count_if(hit).alias("hits")).withColumn("_all", F.lit(1))
    t = running_totals(each, "_all", "score", ["neg"]).agg(
        F.sum(F.col("pos").cast("double") * (2 * F.col("before_neg") + F.col("neg"))).alias("_below"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("pos", "neg", "tp", "hits")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    out = {"roc_auc": F.when(c("pos") * c("neg") > 0, c("_below") / (2 * c("pos") * c("neg"))),
           "precision": ratio(c("tp"), c("hits")), "recall": ratio(c("tp"), c("pos")),
           "f1": ratio(2 * c("tp"), c("hits") + c("pos")), "n": c("pos") + c("neg"), "positives": c("pos")}
    return t.select(*[e.alias(k) for k, e in out.items()]).unpivot([], list(out), "metric", "value")


def _filled(features: DataFrame) -> DataFrame:
    """Missing features count as 0 (the reference fills before scaling)."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in TRUST_FEATURES]
    keep = [c for c in features.columns if c not in TRUST_FEATURES]
    return features.select(*keep, *cols)


@dataclass
class TrustFit:
    model: object            # pyspark.ml.PipelineModel: assembler, scaler, trees
    metrics: dict            # roc_auc, precision, recall, f1 on the hold-out
    train_rows: int
    test_rows: int
    calibration: Calibration = field(default_factory=Calibration)
    loss_by_round: list = field(default_factory=list)
    calibration_errors: dict = field(default_factory=dict)
    held_out: DataFrame | None = None   # the rows that were measured


def trust_pipeline(trees: int = GBT_TREES, seed: int = SEED):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    from .boosting import BoostedTrees
    return Pipeline(stages=[
        VectorAssembler(inputCols=TRUST_FEATURES, outputCol="_raw_features"),
        MinMaxScaler(inputCol="_raw_features", outputCol="features"),
        BoostedTrees(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=GBT_DEPTH,
                     stepSize=GBT_RATE, subsamplingRate=GBT_SUBSAMPLE, seed=seed),
    ])


def fit_trust(features: DataFrame, trees: int = GBT_TREES, seed: int = SEED) -> TrustFit:
    """I8 + I9 + D15: fit scaler and boosted trees on the training split,
    measure on the hold-out.  The boosting counts distinct binned rows on the
    executors; the driver holds only the trees (trees * 2^(depth+1) nodes)."""
    from ..session import checkpoint_dir
    checkpoint_dir(features.sparkSession)
    from pyspark import StorageLevel
    df = stratified_split(_filled(features)).withColumn("label", F.col("has_dq_problem").cast("double"))
    # One row per admission, read by the scaler, the boosting and the metrics: persist
    # for the fit (spills to disk; read again if lost).  A cached plan keeps every shuffle
    # partition; the checkpoint has partitions of the size that adaptive execution chose.
    df = df.checkpoint().persist(StorageLevel.MEMORY_AND_DISK)
    train, test = df.where("NOT is_test"), df.where("is_test")
    model = trust_pipeline(trees, seed).fit(train)
    # Scored once for the metrics and both halves of the calibration.
    tested = predicted(test, model, "hadm_id").persist(StorageLevel.MEMORY_AND_DISK)
    got = {r.metric: r.value for r in classification_metrics(tested).collect()}
    metrics = {k: got[k] for k in ("roc_auc", "precision", "recall", "f1")}
    # Half of the hold-out fits the calibration, the other half measures it.
    half = tested.withColumn("_fits", F.pmod(F.xxhash64("hadm_id"), F.lit(2)) == 0)
    calibration = Calibration.fit(half.where("_fits").select("label", "score"))
    rest = half.where("NOT _fits").select("label", "score")
    errors = {"calibration_error_raw": calibration_error(rest),
              "calibration_error": calibration_error(rest.withColumn("score", calibration.column(F.col("score"))))}
    train_rows = train.count()
    tested.unpersist()
    df.unpersist()
    return TrustFit(model, metrics, train_rows, int(got["n"]), calibration, model.stages[-1].loss_by_round, errors, test)


def predicted(features: DataFrame, model, *keep: str) -> DataFrame:
    """(label, score, predicted) of rows under a fitted model, and the columns ``keep``; the
    score is the probability of a problem."""
    pred = model.transform(_filled(features))
    return pred.select(F.col("has_dq_problem").alias("label"), _p_positive(pred).alias("score"),
                       F.col("prediction").cast("int").alias("predicted"), *keep)


def _p_positive(pred: DataFrame) -> F.Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(pred["probability"])[1]


def score_trust(features: DataFrame, model, calibration: Calibration | None = None) -> DataFrame:
    """trust_score = (1 - p) * 100, unrounded; flagged below 60.  ``calibration``
    turns the model's p into the share of problems observed at that p.
    Returns the ml_trust_scores columns."""
    pred = model.transform(_filled(features))
    p = _p_positive(pred) if calibration is None else calibration.column(_p_positive(pred))
    score = (F.lit(1.0) - p) * F.lit(100.0)
    return pred.select("hadm_id", score.alias("trust_score")) \
        .withColumn("dq_flagged", F.col("trust_score") < TRUST_FLAG_BELOW)


def score_summary(scores: DataFrame) -> DataFrame:
    """D14 for trust: admissions scored and flagged, and the flagged share."""
    return scores.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("dq_flagged")).alias("n_flagged"),
                      F.avg(F.col("dq_flagged").cast("int")).alias("flagged_share"))


def score_rows(rows: DataFrame, model, calibration: Calibration | None = None) -> DataFrame:
    """Score given feature rows (absent features are 0); the score is
    rounded to one digit before the flag, as in the single-row API."""
    for c in TRUST_FEATURES:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0.0))
    pred = model.transform(_filled(rows))
    p = _p_positive(pred) if calibration is None else calibration.column(_p_positive(pred))
    score = F.round((F.lit(1.0) - p) * F.lit(100.0), 1)
    return pred.select("hadm_id", score.alias("trust_score")) \
        .withColumn("dq_flag", F.col("trust_score") < TRUST_FLAG_BELOW)
