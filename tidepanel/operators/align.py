"""Frequency aggregation, alignment, the regular grid, and series checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.keys import PANEL, ROW_KEY, SERIES, SERIES_KEY, TS, VALUE
from tidepanel.operators.joins import attach

UNITS = {"d": "day", "m": "month", "q": "quarter"}
METHODS = ("avg", "sum", "last")


def _period_value(method: str):
    if method == "avg":
        return F.avg(VALUE)
    if method == "sum":
        return F.sum(VALUE)
    if method == "last":
        return F.max_by(VALUE, F.when(F.col(VALUE).isNotNull(), F.col(TS)))
    raise ValueError(f"unknown method {method!r}, expected one of {', '.join(METHODS)}")


def resample(panel: DataFrame, freq: str, method: str = "avg") -> DataFrame:
    """One value per series and period, dated at the period start."""
    if freq not in UNITS:
        raise ValueError(f"unknown frequency {freq!r}, expected one of {', '.join(UNITS)}")
    start = F.date_trunc(UNITS[freq], F.col(TS)).cast("date")
    return (
        panel.groupBy(PANEL, SERIES, start.alias("_period"))
        .agg(_period_value(method).alias(VALUE))
        .withColumnRenamed("_period", TS)
    )


def resample_by_catalog(panel: DataFrame, catalog: DataFrame, method: str = "avg", default_freq: str = "m") -> DataFrame:
    """Each series to the frequency its catalog row names."""
    freq = F.coalesce("freq", F.lit(default_freq))
    unit = F.when(freq == "d", "day").when(freq == "q", "quarter").otherwise("month")
    dated = attach(panel, catalog.select(SERIES, "freq"), [SERIES], salt_by=[PANEL, TS]).withColumn(
        "_period", F.call_function("date_trunc", unit, F.col(TS)).cast("date")
    )
    return (
        dated.groupBy(PANEL, SERIES, "_period").agg(_period_value(method).alias(VALUE)).withColumnRenamed("_period", TS)
    )


def present_series(panel: DataFrame) -> DataFrame:
    """Series with at least one row holding a value."""
    return panel.where(F.col(VALUE).isNotNull()).select(SERIES).distinct()


def keep_present(panel: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog rows with data, ids of catalog series without data)."""
    present = present_series(panel)
    return catalog.join(present, SERIES, "left_semi"), catalog.join(present, SERIES, "left_anti").select(SERIES)


def union_panels(*panels: DataFrame) -> DataFrame:
    """Union of series by date: in long form the outer alignment is a union."""
    out = panels[0]
    for panel in panels[1:]:
        out = out.unionByName(panel)
    return out


def to_wide(panel: DataFrame, series: Sequence[str], value: str = VALUE, extra_keys: Sequence[str] = ()) -> DataFrame:
    """One row per panel and date, one column per named series."""
    return panel.groupBy(PANEL, TS, *extra_keys).pivot(SERIES, list(series)).agg(F.first(value))


def first_of_month(panel: DataFrame) -> DataFrame:
    return panel.where(F.dayofmonth(TS) == 1)


def _spans(panel: DataFrame) -> DataFrame:
    """First and last date per series. As in ``panel_dates`` the count lets Spark
    share the upstream shuffle with the rows joined later."""
    spans = panel.groupBy(PANEL, SERIES).agg(
        F.min(TS).alias("_lo"), F.max(TS).alias("_hi"), F.count(VALUE).alias("_c")
    )
    return spans.where(F.col("_c") >= 0)


def _grid(panel: DataFrame, begin: Column, step: str) -> DataFrame:
    """Every step from ``begin`` to the last date of a panel, for all its series.

    Panel bounds are made from the one-row-per-series table and go back to it.
    """
    spans = _spans(panel)
    bounds = spans.groupBy(PANEL).agg(F.min("_lo").alias("_first"), F.max("_hi").alias("_last"))
    return (
        attach(spans.select(*SERIES_KEY), bounds, [PANEL], salt_by=[SERIES])
        .withColumn("_begin", begin)
        .where(F.col("_begin") <= F.col("_last"))
        .select(*SERIES_KEY, F.explode(F.sequence("_begin", "_last", F.expr(f"interval 1 {step}"))).alias(TS))
    )


def month_grid(panel: DataFrame) -> DataFrame:
    """Every month start between the first and last date of a panel, for every
    series of that panel. Values on other dates are lost, absent ones are NULL."""
    month = F.trunc("_first", "month")
    begin = F.when(month < F.col("_first"), F.add_months(month, 1)).otherwise(month)
    grid = _grid(panel, begin, "month")
    return grid.join(first_of_month(panel), list(ROW_KEY), "left").select(*ROW_KEY, VALUE)


def day_grid(panel: DataFrame) -> DataFrame:
    """As month_grid, with every day of the panel's span."""
    grid = _grid(panel, F.col("_first"), "day")
    return grid.join(panel, list(ROW_KEY), "left").select(*ROW_KEY, VALUE)


class UnknownTarget(ValueError):
    """``names`` is the complete table of valid series; the message lists its first lines."""

    def __init__(self, target: str, names: DataFrame):
        first = [r[0] for r in names.limit(101).collect()]
        more = f" (the first 100; all are in {type(self).__name__}.names)" if len(first) > 100 else ""
        super().__init__(f"target series {target!r} is not in the panel; valid names: {', '.join(first[:100])}{more}")
        self.names = names


def require_target(panel: DataFrame, target: str | None) -> None:
    """Raise ``UnknownTarget``, with the valid names, unless the target is a series."""
    if not target:
        raise ValueError("no target series given")
    if panel.where(F.col(SERIES) == target).limit(1).count():
        return
    raise UnknownTarget(target, panel.select(SERIES).distinct().orderBy(SERIES))
