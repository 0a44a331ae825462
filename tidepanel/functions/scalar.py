"""Scalar column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def known(v: Column) -> Column:
    """NaN and the infinities become NULL; NULL is the only missing value."""
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(INF)), v)


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def to_number(v: Column) -> Column:
    """Text to double; text that is no finite number becomes NULL."""
    return known(v.cast("string").try_cast("double"))


def log100(v: Column) -> Column:
    """100 * ln(v), NULL where v is not positive."""
    return F.when(v > 0, F.lit(100.0) * F.ln(v))


def day_number(ts: Column) -> Column:
    """Proleptic day ordinal, 0001-01-01 is day 1."""
    return F.date_diff(ts, F.lit("0001-01-01").cast("date")) + F.lit(1)


def clamp(v: Column, lower: Column, upper: Column) -> Column:
    """v limited to [lower, upper]; NULL values and NULL bounds leave v alone."""
    return F.when(v > upper, upper).when(v < lower, lower).otherwise(v)


def tidy(v: Column, digits: int = 6) -> Column:
    """Round for output, without a negative zero."""
    return F.round(v, digits) + F.lit(0.0)


def unit_hash_sql(*parts: str) -> str:
    """Uniform [0, 1) number fixed by its arguments, as SQL.

    Unlike ``rand(seed)`` it depends on the key and not on the partition, so a
    recomputed task on another executor gives the same number.
    """
    text = ", ".join(f"cast({p} as string)" for p in parts)
    return f"(cast(conv(substring(md5(concat_ws('|', {text})), 1, 12), 16, 10) as bigint) / {float(16**12)!r}D)"


def unit_hash(*parts: str) -> Column:
    return F.expr(unit_hash_sql(*parts))
