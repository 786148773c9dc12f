"""Scalar column builders.  All are built-in Spark expressions: no Python
runs per row, and everything stays inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import W_ICD, W_MISSING, W_OOR


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def anon_id(col, salt: str) -> Column:
    """First 16 hex characters of SHA-256(salt || id)."""
    return F.substring(F.sha2(F.concat(F.lit(salt), _c(col).cast("string")), 256), 1, 16)


def hour_diff(start, end) -> Column:
    """Number of hour boundaries crossed from start to end.

    SQL engines of the reference count boundaries (10:59 -> 11:01 is 1), which
    equals the whole-hour difference of both ends truncated to the hour.
    """
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", _c(start)),
                            F.date_trunc("HOUR", _c(end)))


def add_minutes(ts, minutes) -> Column:
    return _c(ts) + F.make_dt_interval(mins=_c(minutes).cast("int"))


def nan_to_null(col) -> Column:
    """NaN is a missing value in the source data: make it null."""
    return F.nanvl(_c(col), F.lit(None).cast("double"))


def missing_count(cols) -> Column:
    """How many of the columns are null (int)."""
    return reduce(add, [F.when(_c(c).isNull(), 1).otherwise(0) for c in cols]).cast("int")


def scale_to_range(col, lo: float, hi: float) -> Column:
    return (_c(col) - F.lit(lo)) / F.lit(hi - lo)


def clip01(col) -> Column:
    """Clip to [0, 1]; null stays null (greatest/least skip nulls, so guard)."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def dq_score(missing, chart_rows, oor_total, invalid_icd, diagnoses) -> Column:
    """Rule-based quality score, 0-100, one decimal.

    100 * (1 - .3 * missing share - .2 * out-of-range share - .2 * bad-code share),
    each share capped at 1.  A null share (no diagnoses) counts as 1, because
    least() skips nulls: no diagnoses costs the full 20 points.
    """
    one = F.lit(1.0)
    miss = F.least(_c(missing).cast("double") / F.nullif(_c(chart_rows) * 6, F.lit(0)), one)
    oor = F.least(_c(oor_total).cast("double") / F.nullif(_c(chart_rows), F.lit(0)), one)
    icd = F.least(F.coalesce(_c(invalid_icd), F.lit(0)).cast("double")
                  / F.nullif(_c(diagnoses), F.lit(0)), one)
    return F.round(F.lit(100.0) * (one - F.lit(W_MISSING) * miss - F.lit(W_OOR) * oor
                                   - F.lit(W_ICD) * icd), 1)


def round_avg(col, digits: int = 6) -> Column:
    """Averages are rounded for cross-engine comparison (summation order)."""
    return F.round(_c(col), digits)


def fmt_num(col, decimals: int, null_text: str = "nan") -> Column:
    """Fixed-point text like Python's f"{x:.{decimals}f}"; null prints 'nan'.

    format_number rounds the exact binary value half-to-even, as Python and
    C do; format_string('%.1f') rounds the shortest decimal half-up, which
    differs on ties (0.25 -> '0.3').  Grouping commas are removed.
    """
    c = _c(col)
    return F.when(c.isNull(), F.lit(null_text)).otherwise(
        F.regexp_replace(F.format_number(c.cast("double"), decimals), ",", ""))


def text_or(col, null_text: str = "None") -> Column:
    """String column with Python's rendering of a missing value."""
    return F.coalesce(_c(col).cast("string"), F.lit(null_text))
