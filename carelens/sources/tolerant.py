"""Tolerant loading: malformed values are quarantined instead of failing the run.

A strict cast under ANSI mode ends the job at the first bad string.  Here every
declared column is cast with ``try_cast``; a value that is there but cannot be
cast gets a reason code, and a row with any reason goes, as it came, to the
reject table.  The other rows are exactly what the strict load would give.  One
pass without a shuffle; casts and reasons are column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import RAW_SCHEMAS

REJECTS = "raw_rejects"


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, cast where that is possible, and ``_reasons``:
    '<column>:not_<type>' of each value that is not null and cannot be cast."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    reasons = F.array_compact(F.array(*[
        F.when(F.col(f.name).isNotNull() & cast[f.name].isNull(), F.lit(f"{f.name}:not_{f.dataType.simpleString()}"))
        for f in schema.fields]))
    raw = F.to_json(F.struct(*[F.col(f.name).cast("string").alias(f.name) for f in schema.fields]))
    return df.select(*[c.alias(n) for n, c in cast.items()], reasons.alias("_reasons"), raw.alias("_raw"))


def split_rows(df: DataFrame, name: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows in the declared types, rejects): rejects are (table_name, reasons,
    raw), raw being the row's values as they came, in JSON."""
    schema = schema or RAW_SCHEMAS[name]
    rows = checked(df, schema)
    good = rows.where(F.size("_reasons") == 0).select(*schema.fieldNames())
    bad = rows.where(F.size("_reasons") > 0).select(
        F.lit(name).alias("table_name"), F.array_join("_reasons", ",").alias("reasons"), F.col("_raw").alias("raw"))
    return good, bad


def load_tolerant(spark, raw: dict[str, DataFrame]) -> None:
    """A1 with quarantine: the raw tables and ``raw_rejects``, published together."""
    from .store import Release
    with Release(spark) as release:
        rejects = []
        for name, df in raw.items():
            good, bad = split_rows(df, name)
            release.write(good, name)
            rejects.append(bad)
        release.write(reduce(DataFrame.unionByName, rejects), REJECTS)
        release.publish()
