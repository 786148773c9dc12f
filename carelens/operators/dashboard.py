"""Data behind the dashboard pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FAILURE_TYPES, HIST_BINS, SCATTER_SAMPLE, SEED

LANES = 64
FLAGGED_COLUMNS = ["hadm_id", "trust_score", "admission_type", "los_hours",
                   "total_missing_vitals", "hr_oor_count", "invalid_icd_count", "raw_dq_score"]


def dashboard_summary(summary: DataFrame, trust: DataFrame) -> DataFrame:
    """C4: every summary row with its trust score and flag (left join)."""
    return summary.join(trust.select("hadm_id", "trust_score", "dq_flagged"), "hadm_id", "left")


def kpis(board: DataFrame) -> DataFrame:
    """Admissions, flagged count and share, mean trust, mean missing vitals.
    Nulls are skipped by every aggregate, as pandas does."""
    flagged = F.col("dq_flagged").cast("int")
    return board.agg(F.count(F.lit(1)).alias("total_admissions"),
                     F.coalesce(F.sum(flagged), F.lit(0)).alias("flagged"),
                     F.avg(flagged.cast("double")).alias("flagged_share"),
                     F.avg("trust_score").alias("avg_trust_score"),
                     F.avg("total_missing_vitals").alias("avg_missing_vitals"))


def failures_by_type(board: DataFrame) -> DataFrame:
    """Admissions with at least one failure of each type (long form)."""
    wide = board.agg(*[F.count_if(F.col(c) > 0).alias(name) for name, c in FAILURE_TYPES.items()])
    return wide.unpivot([], list(FAILURE_TYPES), "failure_type", "admissions")


def trust_histogram(board: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over 0-100 (the last bin holds 100)."""
    width = 100.0 / bins
    b = F.least(F.floor(F.col("trust_score") / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (board.where(F.col("trust_score").isNotNull()).groupBy(b.alias("bin")).count()
            .select("bin", (F.col("bin") * F.lit(width)).alias("bin_start"),
                    F.col("count").alias("admissions")))


def flagged(board: DataFrame, types=()) -> DataFrame:
    """B8 + B10 + F2: flagged admissions with the chosen failure types
    present (AND), eight columns, by trust ascending.  The sort is a range
    partitioned sort, not a single task."""
    df = board.where(F.col("dq_flagged") == F.lit(True))
    for t in types:
        df = df.where(F.col(FAILURE_TYPES[t]) > 0)
    return df.select(*FLAGGED_COLUMNS).orderBy("trust_score", "hadm_id")


def scatter_sample(board: DataFrame, n: int = SCATTER_SAMPLE, seed: int = SEED) -> DataFrame:
    """A uniform random sample of min(n, rows) rows (score pair and flag).

    The rows with the n smallest seeded hash keys of hadm_id (uniform, and
    the same on every evaluation and task retry, unlike rand()).  A plain
    orderBy(key).limit(n) merges n rows of every task in one task; here each
    of ``LANES`` groups of tasks keeps its n smallest first (at most n rows
    leave a task), so the last merge sees at most LANES * n rows.
    """
    key = F.sha2(F.concat("hadm_id", F.lit(f":{seed}")), 256)
    keyed = board.select("hadm_id", "raw_dq_score", "trust_score", "dq_flagged", key.alias("_r"),
                         (F.spark_partition_id() % LANES).alias("_lane"))
    w = Window.partitionBy("_lane").orderBy("_r", "hadm_id")
    near = keyed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return near.orderBy("_r", "hadm_id").limit(n).drop("_r", "_lane", "_n")
