"""Anomaly scoring of time points (B6, D2, D10-D14, I1, I2, I4-I6; E1 and E2 re-aimed: every time point with a
clean reading trains the model, in place of the first readings of each vital).

The model interface is ``fit(train) -> model`` and
``model.error_columns(df, scaled_columns)``, which adds reconstruction_error.
``MeanModel`` reconstructs every vital by its training mean (SQL-expressible,
used by the oracle checks); ``reconstruct.PcaModel`` is the production model.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (ANOMALY_PERCENTILE, CLEAN_UPPER_STRETCH,
                         VITAL_RANGES, VITALS)
from ..functions import clip01, scale_to_range
from .ranks import quantiles, value_counts

# Model parameters are rounded so that two engines summing in different
# orders still hold the same numbers.
PARAM_DIGITS = 9


def _range_case(which: int) -> F.Column:
    """CASE vital_name WHEN ... THEN lo|hi END from the fixed range table."""
    e = None
    for v in VITALS:
        val = F.lit(VITAL_RANGES[v][which])
        e = F.when(F.col("vital_name") == v, val) if e is None else e.when(F.col("vital_name") == v, val)
    return e


def clean_readings(charts: DataFrame) -> DataFrame:
    """Non-null readings between lo and hi * 1.5 of their vital.

    One scan with a CASE over the six ranges (the reference ran six queries).
    """
    lo, hi = _range_case(0), _range_case(1) * F.lit(CLEAN_UPPER_STRETCH)
    return (charts.where(F.col("valuenum").isNotNull() & F.col("vital_name").isin(VITALS))
            .where(F.col("valuenum").between(lo, hi))
            .select("hadm_id", "subject_id", "charttime", "vital_name", "valuenum"))


def scale_vitals(df: DataFrame, keep=()) -> DataFrame:
    """Min-max scale each vital to its fixed range and clip to [0, 1]."""
    return df.select(*keep, *[clip01(scale_to_range(v, *VITAL_RANGES[v])).alias(v) for v in VITALS])


def train_matrix(pivot: DataFrame, medians: dict) -> DataFrame:
    """Every time point with a clean reading; unclean or missing vitals are
    filled with the medians, all are scaled.  No shuffle beyond the pivot."""
    clean = {v: F.when(F.col(v).between(VITAL_RANGES[v][0], VITAL_RANGES[v][1] * CLEAN_UPPER_STRETCH), F.col(v))
             for v in VITALS}
    rows = pivot.select("hadm_id", "charttime", *[e.alias(v) for v, e in clean.items()])
    some = reduce(lambda x, y: x | y, [F.col(v).isNotNull() for v in VITALS])
    return scale_vitals(impute(rows.where(some), medians), keep=["hadm_id", "charttime"])


def shortest_column(charts: DataFrame) -> DataFrame:
    """The smallest count of clean readings of a vital."""
    return clean_readings(charts).groupBy("vital_name").count().agg(F.min("count").alias("n_rows"))


def scoring_pivot(vitals: DataFrame) -> DataFrame:
    """Wide rows by (hadm_id, charttime), from the mart's wide rows."""
    return vitals.groupBy("hadm_id", "charttime").agg(*[F.max(v).alias(v) for v in VITALS])


def median_frame(pivot: DataFrame, relative_error: float | None = None) -> DataFrame:
    """One row of six medians, nulls skipped.  Exact by ranks over range
    partitions; relative_error asks for the one-pass sketch instead."""
    if relative_error is None:
        q = quantiles(value_counts(pivot, VITALS), 0.5)
        exprs = [F.max(F.when(F.col("name") == v, F.col("quantile"))) for v in VITALS]
    else:
        q, exprs = pivot, [F.percentile_approx(v, 0.5, int(round(1.0 / relative_error))) for v in VITALS]
    return q.agg(*[F.round(e, PARAM_DIGITS).alias(v) for e, v in zip(exprs, VITALS)])


def column_medians(pivot: DataFrame, relative_error: float | None = None) -> dict:
    """Fit the imputer: six medians as driver-side scalars."""
    row = median_frame(pivot, relative_error).first()
    return {v: (None if row[v] is None else float(row[v])) for v in VITALS}


def impute(pivot: DataFrame, medians: dict) -> DataFrame:
    """Fill missing vitals of the scoring pivot with the fitted medians
    (literals, no join)."""
    return pivot.select("hadm_id", "charttime", *[
        (F.coalesce(F.col(v), F.lit(medians[v]).cast("double")) if medians[v] is not None
         else F.col(v)).alias(v) for v in VITALS])


def squared_error(scaled_cols, recon: dict) -> F.Column:
    """Mean of squared differences over the six vitals (fixed order)."""
    terms = [(F.col(v) - F.lit(recon[v])) * (F.col(v) - F.lit(recon[v])) for v in scaled_cols]
    return reduce(add, terms) / F.lit(float(len(terms)))


@dataclass
class MeanModel:
    """Reconstruct each vital by its training mean; threshold = p95 of
    training errors (linear interpolation, like numpy)."""
    means: dict = field(default_factory=dict)
    threshold: float | None = None
    mean_error: float | None = None
    kind: str = "mean"

    @classmethod
    def fit(cls, train: DataFrame) -> "MeanModel":
        m = train.agg(*[F.round(F.avg(v), PARAM_DIGITS).alias(v) for v in VITALS]).first()
        means = {v: float(m[v]) for v in VITALS}
        model = cls(means)
        t = threshold_frame(train, model).first()
        model.threshold, model.mean_error = float(t["threshold"]), float(t["mean_error"])
        return model

    def error_columns(self, df: DataFrame, cols) -> DataFrame:
        """Add reconstruction_error for the scaled vitals in ``cols``."""
        recon = {c: self.means[v] for c, v in zip(cols, VITALS)}
        return df.withColumn("reconstruction_error", squared_error(cols, recon))


def threshold_frame(train: DataFrame, model) -> DataFrame:
    """The p95 threshold (linear interpolation) and mean training error, one row."""
    errors = value_counts(model.error_columns(train, VITALS), ["reconstruction_error"])
    return quantiles(errors, ANOMALY_PERCENTILE).agg(F.max("quantile").alias("threshold"),
                                                     F.max("mean").alias("mean_error"))


def flag(errors: DataFrame, threshold: float) -> DataFrame:
    """Error above the threshold as 0/1; a null (NaN) error is never flagged."""
    e = F.col("reconstruction_error")
    return errors.withColumn(
        "anomaly_flag", F.when(e.isNotNull() & ~F.isnan(e) & (e > F.lit(threshold)), 1).otherwise(0))


def score_anomalies(vitals: DataFrame, model, medians: dict | None = None) -> DataFrame:
    """D2 -> I2 -> I1 -> I4 -> I5: the ml_anomaly_scores table.

    Columns: hadm_id, charttime, six un-imputed vitals, reconstruction_error,
    anomaly_flag.  One lazy plan; the imputer and model parameters are
    literals or a broadcast, so scoring adds no shuffle beyond the pivot.
    """
    return score_pivot(scoring_pivot(vitals), model, medians)


def score_pivot(pivot: DataFrame, model, medians: dict | None = None) -> DataFrame:
    """I2 -> I1 -> I4 -> I5 for a pivot that is at hand (stored): no shuffle."""
    if medians is None:
        medians = column_medians(pivot)
    scaled_cols = [f"_s_{v}" for v in VITALS]
    both = pivot.select("hadm_id", "charttime", *VITALS, *[
        clip01(scale_to_range(F.coalesce(F.col(v), F.lit(medians[v]).cast("double"))
                              if medians[v] is not None else F.col(v),
                              *VITAL_RANGES[v])).alias(s) for v, s in zip(VITALS, scaled_cols)])
    scored = model.error_columns(both, scaled_cols)
    return (flag(scored, model.threshold)
            .select("hadm_id", "charttime", *VITALS, "reconstruction_error", "anomaly_flag"))


def anomaly_rollup(scores: DataFrame) -> DataFrame:
    """Mean error and number of flags per admission."""
    return scores.groupBy("hadm_id").agg(
        F.avg("reconstruction_error").alias("avg_recon_error"),
        F.sum("anomaly_flag").alias("flagged_count"))


def scoring_summary(scores: DataFrame) -> DataFrame:
    """Rows, flagged, flagged share."""
    return scores.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.sum("anomaly_flag").alias("n_flagged"),
                      (F.sum("anomaly_flag") / F.count(F.lit(1))).alias("flagged_share"))
