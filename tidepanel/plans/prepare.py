"""From a raw panel to a prepared one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.keys import PANEL, SERIES, SERIES_KEY, SPLIT, SPLIT_KEY, TS, VALUE
from tidepanel.operators import align, clean, impute, split, stationarity, transform
from tidepanel.operators.blocks import settled
from tidepanel.operators.joins import Names, attach, by_series, named
from tidepanel.plans.config import PrepareConfig
from tidepanel.session import cut_lineage
from tidepanel.sources.panel_io import select_observations


def load(panel: DataFrame, catalog: DataFrame, target: str, *, start=None, end=None, method: str = "avg") -> DataFrame:
    """Observations in range, each series at its own frequency, on month starts."""
    return load_reported(panel, catalog, target, start=start, end=end, method=method)[0]


def load_reported(
    panel: DataFrame, catalog: DataFrame, target: str, *, start=None, end=None, method: str = "avg"
) -> tuple[DataFrame, DataFrame]:
    """What :func:`load` gives, and the series of the catalog that are skipped as they have no value in range."""
    wanted = select_observations(panel, start=start, end=end).join(catalog.select(SERIES), SERIES, "left_semi")
    grid = align.month_grid(align.resample_by_catalog(wanted, catalog, method))
    align.require_target(grid, target)
    return grid, align.keep_present(wanted, catalog)[1]


@dataclass(frozen=True)
class Preparation:
    """``rows`` as :func:`preprocess` gives them; ``choices``: method and adf_stat per series and split;
    ``skipped``: series of the catalog without data."""

    rows: DataFrame
    choices: DataFrame
    skipped: DataFrame


def prepare(panel: DataFrame, catalog: DataFrame, cfg: PrepareConfig, *, start=None, end=None, method: str = "avg") -> Preparation:
    """From raw observations to prepared rows, the catalog giving each series its frequency and its roles."""
    grid, skipped = load_reported(panel, catalog, cfg.target, start=start, end=end, method=method)
    rows = cut_lineage(preprocess(grid, cfg, **roles(catalog), with_stat=True))
    return Preparation(rows.drop("adf_stat"), choices(rows), skipped)


def roles(catalog: DataFrame) -> dict[str, DataFrame]:
    """Tables of the series to spline, to deflate and to log."""
    return {"spline": catalog.where("spline"), "nominal": catalog.where("nominal"), "logged": catalog.where("log")}


def choices(rows: DataFrame) -> DataFrame:
    """(panel_id, series_id, split, method, adf_stat), one row each, of rows prepared ``with_stat``."""
    return rows.groupBy(*SPLIT_KEY).agg(F.max("method").alias("method"), F.max("adf_stat").alias("adf_stat"))


def drop_empty_series(panel: DataFrame, blocks: bool = False) -> DataFrame:
    if blocks:
        known = panel.groupBy(*SERIES_KEY).agg(F.count(VALUE).alias("_known")).where(F.col("_known") > 0)
        return attach(panel, known, list(SERIES_KEY), how="inner", salt_by=[TS]).drop("_known")
    known = F.count(VALUE).over(Window.partitionBy(*SERIES_KEY))
    return panel.withColumn("_known", known).where(F.col("_known") > 0).drop("_known")


def drop_incomplete_dates(panel: DataFrame, target: str) -> DataFrame:
    """Dates on which any predictor is NULL lose their predictors, dates without a
    target value their target."""
    dates = (
        panel.where(F.col(SERIES) != target)
        .groupBy(PANEL, SPLIT, TS)
        .agg((F.count(VALUE) == F.count(F.lit(1))).alias("_complete"))
    )
    marked = attach(panel, dates, [PANEL, SPLIT, TS], salt_by=[SERIES])
    keep = F.col(VALUE).isNotNull() & ((F.col(SERIES) == target) | F.col("_complete"))
    return by_series(marked.where(keep).drop("_complete"))


def preprocess(
    panel: DataFrame,
    cfg: PrepareConfig,
    *,
    spline: Names = (),
    nominal: Names = (),
    logged: Names = (),
    with_stat: bool = False,
) -> DataFrame:
    """(panel_id, series_id, ts, split, value, method) ready for feature work, and adf_stat if asked for.

    Order: split, spline imputation, deflation, 100 ln, z-score fitted on train,
    percent change, transform choice, outlier capping on train. Roles are lists of
    names, or tables of them, such as :func:`roles` takes from a catalog. Series named
    in a role but absent are skipped; an absent deflator is an error.

    The input is written to the checkpoint folder once: the date cut, the deflator
    and the complete dates each look at it apart from the rows.
    """
    keys, days = list(SPLIT_KEY), cfg.block_days
    parted = split.chrono_split(cut_lineage(drop_empty_series(panel, days is not None)), cfg.test_fraction)
    if named(spline):
        parted = impute.spline_impute(
            settled(parted, days), series=spline, per_split=cfg.fit_scope == "split", block_days=days
        )
    if named(nominal) and cfg.deflator:
        parted = transform.deflate(parted, cfg.deflator, nominal)
    if named(logged):
        parted = transform.log_transform(parted, logged)
    scaled = transform.standardise_blocks(parted) if days else transform.standardise(by_series(parted))
    scaled = settled(scaled, days)
    changed = transform.percent_change(scaled, keys=keys, block_days=days)
    rows = settled(drop_incomplete_dates(settled(changed, days), cfg.target), days)
    choice = None
    if cfg.choose_on == "train":
        train = rows.where(F.col(SPLIT) == split.TRAIN)
        choice = stationarity.choose_transform(train, statistic=cfg.statistic, block_days=days).drop(SPLIT)
    shaped = stationarity.apply_transform(rows, choice, statistic=cfg.statistic, block_days=days, with_stat=with_stat)
    return clean.cap_outliers(shaped, cap_factor=cfg.cap_factor, blocks=days is not None)
