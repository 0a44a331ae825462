"""Deflation, logs, standardising, changes and rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidepanel.functions.scalar import log100
from tidepanel.keys import PANEL, SERIES, SERIES_KEY, SPLIT, TS, VALUE
from tidepanel.operators.blocks import over_series, settled
from tidepanel.operators.joins import Names, attach, with_flag
from tidepanel.operators.split import TRAIN

ROLL_MEAN = 7
ROLL_PLOT = 12


def deflate(panel: DataFrame, deflator: str, nominal: Names, *, check: bool = True) -> DataFrame:
    """value / deflator * 100 on the same date for the nominal series.

    The deflator has one row per panel and date; a date of a panel with very many
    series is dealt over several tasks by the salted join. ``check`` looks, in a
    job of its own, whether the deflator is there at all.
    """
    if check and not panel.where(F.col(SERIES) == deflator).limit(1).count():
        raise ValueError(f"deflator series {deflator!r} is not in the panel")
    keys = [PANEL, TS]
    index = panel.where(F.col(SERIES) == deflator).select(*keys, F.col(VALUE).alias("_deflator"))
    joined = with_flag(attach(panel, index, keys, salt_by=[SERIES]), nominal, "_nominal")
    scaled = F.try_divide(F.col(VALUE), F.col("_deflator")) * F.lit(100.0)
    return joined.withColumn(VALUE, F.when(F.col("_nominal"), scaled).otherwise(F.col(VALUE))).select(*panel.columns)


def log_transform(panel: DataFrame, logged: Names) -> DataFrame:
    flagged = with_flag(panel, logged, "_logged")
    return flagged.withColumn(VALUE, F.when(F.col("_logged"), log100(F.col(VALUE))).otherwise(F.col(VALUE))).drop("_logged")


def standardise(panel: DataFrame, *, keys: Sequence[str] = SERIES_KEY, column: str = VALUE) -> DataFrame:
    """z-score with mean and population deviation of the training rows, on all rows.

    Fit and use share one shuffle: both are windows over the series.
    """
    w = Window.partitionBy(*keys)
    fit = F.when(F.col(SPLIT) == TRAIN, F.col(column)) if SPLIT in panel.columns else F.col(column)
    fitted = panel.withColumns({"_mean": F.avg(fit).over(w), "_sd": F.stddev_pop(fit).over(w)})
    return fitted.withColumn(column, _z(F.col(column), F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def standardise_fit(panel: DataFrame, *, keys: Sequence[str] = SERIES_KEY, column: str = VALUE) -> DataFrame:
    """The scaler alone: mean and sd per series, from partial aggregates."""
    fit = F.when(F.col(SPLIT) == TRAIN, F.col(column)) if SPLIT in panel.columns else F.col(column)
    return panel.groupBy(*keys).agg(F.avg(fit).alias("mean"), F.stddev_pop(fit).alias("sd"))


def standardise_blocks(panel: DataFrame, *, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """As ``standardise``, for series cut into blocks: the fit is a partial aggregate
    and comes back by a salted join, so no task holds a whole series."""
    fit = standardise_fit(panel, keys=keys)
    fitted = attach(panel, fit, list(keys), salt_by=[TS])
    return fitted.withColumn(VALUE, _z(F.col(VALUE), F.col("mean"), F.col("sd"))).drop("mean", "sd")


def _z(v: Column, mean: Column, sd: Column) -> Column:
    return (v - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def _previous_value(column: str, w: WindowSpec) -> Column:
    return F.lag(column).over(w)


def difference(
    panel: DataFrame, *, column: str = VALUE, keys: Sequence[str] = SERIES_KEY, block_days: int | None = None
) -> DataFrame:
    return over_series(
        panel,
        [lambda w: {column: F.col(column) - _previous_value(column, w)}],
        before=1,
        keys=keys,
        block_days=block_days,
    )


def percent_change(
    panel: DataFrame, *, column: str = VALUE, keys: Sequence[str] = SERIES_KEY, block_days: int | None = None
) -> DataFrame:
    """Relative change to the row before, after a forward fill; NULL over a zero.

    In blocks, the fill needs the last known value before a block. Both the fill
    and the lag then reach one row: the fill runs first on its own halo.
    """
    def change(w: WindowSpec) -> dict[str, Column]:
        return {column: F.try_divide(F.col(column) - _previous_value(column, w), _previous_value(column, w))}

    def fill(w: WindowSpec) -> dict[str, Column]:
        return {column: F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))}

    if block_days is None:
        return over_series(panel, [fill, change], keys=keys)
    filled = over_series(panel, [fill], before=1, anchor=F.col(column).isNotNull(), keys=keys, block_days=block_days)
    return over_series(settled(filled, block_days), [change], before=1, keys=keys, block_days=block_days)


def _full_window(agg: Column, column: str, w: WindowSpec, window: int) -> Column:
    frame = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(column).over(frame) == window, agg.over(frame))


def rolling(
    panel: DataFrame,
    *,
    window: int,
    mean: str | None = "rolling_mean",
    std: str | None = None,
    column: str = VALUE,
    keys: Sequence[str] = SERIES_KEY,
    block_days: int | None = None,
) -> DataFrame:
    """Rolling mean and/or sample deviation, NULL until the window is full."""

    def step(w: WindowSpec) -> dict[str, Column]:
        out = {}
        if mean:
            out[mean] = _full_window(F.avg(column), column, w, window)
        if std:
            out[std] = _full_window(F.stddev_samp(column), column, w, window)
        return out

    return over_series(panel, [step], before=window - 1, keys=keys, block_days=block_days)


def detrend(
    panel: DataFrame,
    *,
    window: int = ROLL_MEAN,
    then_difference: bool = False,
    column: str = VALUE,
    keys: Sequence[str] = SERIES_KEY,
    block_days: int | None = None,
) -> DataFrame:
    """Subtract the rolling mean, optionally differencing the remainder."""
    steps = [lambda w: {"_d": F.col(column) - _full_window(F.avg(column), column, w, window)}]
    if then_difference:
        steps.append(lambda w: {"_d": F.col("_d") - _previous_value("_d", w)})
    out = over_series(panel, steps, before=window - 1 + int(then_difference), keys=keys, block_days=block_days)
    return out.withColumn(column, F.col("_d")).drop("_d")


def variant_steps(column: str = VALUE) -> list:
    """Window steps for the four transforms a series may take, as v0..v3."""
    first = lambda w: {
        "v0": F.col(column),
        "v1": F.col(column) - _previous_value(column, w),
        "v2": F.col(column) - _full_window(F.avg(column), column, w, ROLL_MEAN),
    }
    second = lambda w: {"v3": F.col("v2") - _previous_value("v2", w)}
    return [first, second]


def stationarity_variants(
    panel: DataFrame, *, column: str = VALUE, keys: Sequence[str] = SERIES_KEY, block_days: int | None = None
) -> DataFrame:
    """The four transforms as columns v0..v3, in one shuffle."""
    return over_series(panel, variant_steps(column), before=ROLL_MEAN, keys=keys, block_days=block_days)
