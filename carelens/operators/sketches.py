"""Mergeable quantile sketches (D11, D12 for data that grows by the day).

A KLL sketch per column and day is stored; medians and the anomaly threshold
over any span of days come from merging stored sketches, so a daily run reads
that day's rows only.  One map-side combined aggregate; a sketch has a few times
k numbers whatever the number of rows.  A sketched quantile is a value of the
column whose rank is off by at most ``rank_error(k)`` of the rows (99 % of the
time); up to k values a column and day it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ANOMALY_PERCENTILE, VITALS

SKETCH_K = 2000
NULL_DAY = "none"


def rank_error(k: int = SKETCH_K) -> float:
    """Single-sided normalised rank error of a KLL sketch at 99 % confidence (the
    fit published with the sketch's open-source implementation)."""
    return 2.296 / k ** 0.9723


def daily_sketches(rows: DataFrame, columns: list[str], time: str = "charttime", k: int = SKETCH_K) -> DataFrame:
    """(name, sketch, day) of each column and day; null values are skipped, a null
    time is a day of its own."""
    day = F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(NULL_DAY))
    long = rows.select(day.alias("day"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["day"], columns, "name", "value").where("value IS NOT NULL")
    return long.groupBy("name", "day").agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")).select("name", "sketch", "day")


def store_daily(sketches: DataFrame, path: str) -> None:
    """Write the sketches of some days; a day that was stored before is replaced, the
    others stay, so a repeated run changes nothing."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def stored_daily(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored sketches, of a span of days if given (pruned to their folders)."""
    df = spark.read.schema("name string, sketch binary, day string").parquet(path)
    if first is not None:
        df = df.where(F.col("day") >= first)
    return df if last is None else df.where(F.col("day") <= last)


def sketched_quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(name, n, one column for each share) over all the sketches given, merged."""
    merged = sketches.groupBy("name").agg(F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select("name", F.kll_sketch_get_n_double("s").alias("n"),
                         *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(c) for c, q in shares.items()])


def sketched_medians(sketches: DataFrame) -> dict:
    """The imputer (D12) from stored sketches: six medians, None where no value was seen."""
    got = {r["name"]: r["median"] for r in sketched_quantiles(sketches.where(F.col("name").isin(VITALS)), {"median": 0.5}).collect()}
    return {v: got.get(v) for v in VITALS}


def sketched_threshold(sketches: DataFrame) -> float | None:
    """The anomaly threshold (D11) from stored sketches of reconstruction_error."""
    row = sketched_quantiles(sketches.where("name = 'reconstruction_error'"), {"threshold": ANOMALY_PERCENTILE}).first()
    return None if row is None else row["threshold"]


def within_error(quantiles: DataFrame, rows: DataFrame, columns: list[str], shares: dict[str, float], error: float) -> DataFrame:
    """(name, n, <share>_within ...): is each sketched quantile's true rank among
    ``rows`` within ``error`` of its share?  An audit by one scan; the quantiles have
    one row a column."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "value").where("value IS NOT NULL")
    at = long.join(F.broadcast(quantiles.withColumnRenamed("n", "_n")), "name")
    ranks = at.groupBy("name").agg(F.count("*").alias("n"), F.max("_n").alias("_n"), *[e for c in shares for e in (
        F.count_if(F.col("value") < F.col(c)).alias(f"{c}_below"), F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_upto"))])
    ok = [((F.col(f"{c}_below") <= (q + error) * F.col("n")) & (F.col(f"{c}_upto") >= (q - error) * F.col("n"))
           & (F.col("n") == F.col("_n"))).alias(f"{c}_within") for c, q in shares.items()]
    return ranks.select("name", "n", *ok)
