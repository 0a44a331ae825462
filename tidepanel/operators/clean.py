"""Fills, interpolation, cleaning and outlier capping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidepanel.functions.scalar import clamp, to_number
from tidepanel.keys import SERIES_KEY, SPLIT, TS, VALUE
from tidepanel.operators.blocks import over_series, row_position
from tidepanel.operators.joins import attach
from tidepanel.operators.split import TRAIN


def _previous(column: str | Column, w: WindowSpec) -> Column:
    return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _next(column: str | Column, w: WindowSpec) -> Column:
    return F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def forward_fill(
    panel: DataFrame, column: str = VALUE, *, keys: Sequence[str] = SERIES_KEY, block_days: int | None = None
) -> DataFrame:
    return over_series(
        panel,
        [lambda w: {column: _previous(column, w)}],
        before=1,
        anchor=F.col(column).isNotNull(),
        keys=keys,
        block_days=block_days,
    )


def backward_fill(
    panel: DataFrame, column: str = VALUE, *, keys: Sequence[str] = SERIES_KEY, block_days: int | None = None
) -> DataFrame:
    return over_series(
        panel,
        [lambda w: {column: _next(column, w)}],
        after=1,
        anchor=F.col(column).isNotNull(),
        keys=keys,
        block_days=block_days,
    )


def interpolate_linear(
    panel: DataFrame, column: str = VALUE, *, keys: Sequence[str] = SERIES_KEY, block_days: int | None = None
) -> DataFrame:
    """Straight line by row position between known values. Leading gaps stay,
    trailing ones take the last known value."""
    numbered = row_position(panel, keys=keys, block_days=block_days, name="_rn")
    mark = F.when(F.col(column).isNotNull(), F.struct(F.col("_rn").alias("p"), F.col(column).alias("v")))

    def line(w: WindowSpec) -> dict[str, Column]:
        return {"_a": _previous(mark, w), "_b": _next(mark, w)}

    out = over_series(
        numbered,
        [line],
        before=1,
        after=1,
        anchor=F.col(column).isNotNull(),
        keys=keys,
        block_days=block_days,
    )
    span = (F.col("_b.p") - F.col("_a.p")).cast("double")
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * ((F.col("_rn") - F.col("_a.p")).cast("double") / span)
    filled = (
        F.when(F.col(column).isNotNull(), F.col(column))
        .when(F.col("_a").isNull(), F.lit(None).cast("double"))
        .when(F.col("_b").isNull(), F.col("_a.v"))
        .otherwise(between)
    )
    return out.withColumn(column, filled).drop("_rn", "_a", "_b")


def clean_series(panel: DataFrame, *, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Coerce to finite numbers, fill backward, then forward, interpolate, and put
    the series mean where a value is still missing.

    After the two fills a series is complete or has no value at all, so the
    later steps have nothing left to work on; they need no pass of their own.
    """
    numeric = panel.withColumn(VALUE, to_number(F.col(VALUE)))
    return over_series(
        numeric,
        [lambda w: {VALUE: _next(VALUE, w)}, lambda w: {VALUE: _previous(VALUE, w)}],
        keys=keys,
    )


def quartile_bounds(
    panel: DataFrame, *, cap_factor: float = 3.0, keys: Sequence[str] = SERIES_KEY, approximate: bool = False
) -> DataFrame:
    """Outlier bounds per series from its training rows (all rows without a split).

    Exact interpolated quartiles; ``approximate`` takes mergeable sketches, for
    series where holding the distinct values of one series is too much.
    """
    rows = panel.where(F.col(SPLIT) == TRAIN) if SPLIT in panel.columns else panel
    quarts = F.array(F.lit(0.25), F.lit(0.75))
    q = F.percentile_approx(VALUE, [0.25, 0.75], 10_000) if approximate else F.percentile(VALUE, quarts)
    fit = rows.groupBy(*keys).agg(q.alias("_q"))
    return fit.select(*keys, *_bounds(F.col("_q"), cap_factor))


def _bounds(q: Column, cap_factor: float) -> list[Column]:
    q1, q3 = q[0], q[1]
    reach = F.lit(float(cap_factor)) * (q3 - q1)
    return [(q1 - reach).alias("lower"), (q3 + reach).alias("upper")]


def cap_outliers(
    panel: DataFrame,
    *,
    cap_factor: float = 3.0,
    keys: Sequence[str] = SERIES_KEY,
    approximate: bool = False,
    blocks: bool = False,
) -> DataFrame:
    """Limit training values to quartile -/+ factor * IQR; test rows pass as they are.

    The exact form fits and applies in one shuffle, as a window over the series. With
    ``blocks`` the same quartiles come from partial aggregates and a salted join, so
    no task holds a whole series' rows.
    """
    split = SPLIT in panel.columns
    applies = F.col(SPLIT) == TRAIN if split else F.lit(True)
    if approximate or blocks:
        bounds = quartile_bounds(panel, cap_factor=cap_factor, keys=keys, approximate=approximate)
        fitted = attach(panel, bounds, list(keys), salt_by=[TS])
    else:
        fit_value = F.when(applies, F.col(VALUE))
        quarts = F.percentile(fit_value, F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy(*keys))
        fitted = panel.withColumn("_q", quarts)
        lower, upper = _bounds(F.col("_q"), cap_factor)
        fitted = fitted.withColumns({"lower": lower, "upper": upper}).drop("_q")
    capped = F.when(applies, clamp(F.col(VALUE), F.col("lower"), F.col("upper"))).otherwise(F.col(VALUE))
    return fitted.withColumn(VALUE, capped).drop("lower", "upper")


