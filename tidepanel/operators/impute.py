"""Cubic-spline imputation, whole series or blocks with a halo of knots."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.scalar import day_number
from tidepanel.functions.spline import fill_gaps
from tidepanel.keys import SERIES_KEY, SPLIT, TS, VALUE
from tidepanel.operators.blocks import BLOCK, HALO, add_halo
from tidepanel.operators.joins import Names, with_flag

# A knot this many knots away changes a spline coefficient by 0.268 ** 32 of its
# own size, which is below double precision.
HALO_KNOTS = 32


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _fill(days: pd.Series, values: pd.Series) -> pd.Series:
    def one(d, v):
        if v is None:
            return None
        out = fill_gaps(np.asarray(d, dtype=float), np.asarray(v, dtype=float))
        return [None if np.isnan(a) else a for a in out]

    return pd.Series([one(d, v) for d, v in zip(days, values)])


def spline_impute(
    panel: DataFrame,
    *,
    series: Names | None = None,
    per_split: bool = True,
    block_days: int | None = None,
) -> DataFrame:
    """Fill missing values by a not-a-knot cubic spline over the day number.

    Known values stay. Only the named series are filled (all when None), others
    never leave the JVM. Fits are per split when the panel has one.
    With ``block_days`` a long series is cut into blocks solved side by side.
    """
    split = SPLIT in panel.columns
    keys = [*SERIES_KEY, SPLIT] if split and per_split else list(SERIES_KEY)
    columns, wanted = panel.columns, F.lit(True)
    if series is not None:  # a fact of the series, so it can stand among its keys
        panel, wanted, keys = with_flag(panel, series, "_wanted"), F.col("_wanted"), [*keys, "_wanted"]
    if block_days is None:
        return _fill_groups(panel, keys, wanted).select(*columns)
    halo = add_halo(
        panel,
        block_days=block_days,
        before=HALO_KNOTS,
        after=HALO_KNOTS,
        anchor=F.col(VALUE).isNotNull(),
        keys=keys,
    )
    out = _fill_groups(halo, [*keys, BLOCK], wanted)
    return out.where(~F.col(HALO)).select(*columns)


def _fill_groups(df: DataFrame, keys: Sequence[str], wanted: Column) -> DataFrame:
    columns = df.columns
    extra = [c for c in columns if c not in keys and c not in (TS, VALUE)]
    rows = F.sort_array(F.collect_list(F.struct(TS, VALUE, *extra)))
    grouped = df.groupBy(*keys).agg(rows.alias("_rows"))
    # A complete series and an unwanted one are passed to Python as NULL.
    gaps = F.exists("_rows", lambda r: r[VALUE].isNull())
    days = F.transform("_rows", lambda r: day_number(r[TS]).cast("double"))
    values = F.transform("_rows", lambda r: r[VALUE])
    filled = _fill(F.when(wanted & gaps, days), F.when(wanted & gaps, values))
    exploded = grouped.withColumn("_filled", filled).select(
        *keys, F.col("_filled"), F.posexplode("_rows").alias("_i", "_r")
    )
    value = F.when(F.col("_filled").isNull(), F.col(f"_r.{VALUE}")).otherwise(F.col("_filled")[F.col("_i")])
    return exploded.select(
        *keys, F.col(f"_r.{TS}").alias(TS), value.alias(VALUE), *[F.col(f"_r.{c}").alias(c) for c in extra]
    ).select(*columns)
