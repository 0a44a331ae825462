"""Target projection, chronological split, NULL filters and feature membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.keys import PANEL, SERIES, SPLIT, TS, VALUE
from tidepanel.operators.joins import attach, by_series

TRAIN, TEST = "train", "test"


def with_role(panel: DataFrame, target: str) -> DataFrame:
    """Mark each row as belonging to the target or to a predictor."""
    return panel.withColumn("role", F.when(F.col(SERIES) == target, "target").otherwise("predictor"))


def predictors(panel: DataFrame, target: str) -> DataFrame:
    return panel.where(F.col(SERIES) != target)


def only_target(panel: DataFrame, target: str) -> DataFrame:
    return panel.where(F.col(SERIES) == target)


def panel_dates(panel: DataFrame) -> DataFrame:
    """Distinct dates per panel.

    Counting the values, always true as a filter, keeps the value column in this
    branch: its upstream shuffle is then the very one of the rows it is joined
    back to, and Spark runs it once for both.
    """
    return panel.groupBy(PANEL, TS).agg(F.count(VALUE).alias("_c")).where(F.col("_c") >= 0).select(PANEL, TS)


def split_cutoff(panel: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """Last training date per panel; the last ceil(fraction * n) dates are test.

    The window runs over distinct dates of a panel, which the calendar bounds.
    """
    dates = panel_dates(panel)
    w = Window.partitionBy(PANEL)
    ranked = dates.withColumns(
        {
            "_rn": F.row_number().over(w.orderBy(TS)),
            "_n": F.count(F.lit(1)).over(w),
        }
    )
    n_test = F.ceil(F.lit(float(test_fraction)) * F.col("_n"))
    return ranked.where(F.col("_rn") == F.col("_n") - n_test).select(PANEL, F.col(TS).alias("cutoff"))


def chrono_split(panel: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """Add ``split``: one date cut per panel, no shuffling of rows in time."""
    cut = attach(panel, split_cutoff(panel, test_fraction), [PANEL])
    labelled = cut.withColumn(SPLIT, F.when(F.col(TS) <= F.col("cutoff"), TRAIN).otherwise(TEST)).drop("cutoff")
    return by_series(labelled)


def combine_wide(left: DataFrame, right: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Re-join predictor and target columns by panel and date, keeping both sides."""
    return left.join(right, [PANEL, TS, *extra_keys], "full")


def drop_incomplete_rows(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    return wide.dropna(how="any", subset=list(columns))


def complete_features(features: DataFrame, keys: Sequence[str] = (PANEL,), value: str = VALUE) -> DataFrame:
    """Names of the features that hold a value on every date of their group."""
    dates = features.select(*keys, TS).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_dates"))
    counts = features.groupBy(*keys, "feature").agg(F.count(value).alias("_known"), F.count(F.lit(1)).alias("_rows"))
    return (
        attach(counts, dates, list(keys), salt_by=["feature"])
        .where((F.col("_known") == F.col("_rows")) & (F.col("_rows") == F.col("_dates")))
        .select(*keys, "feature")
    )


def drop_incomplete_features(features: DataFrame, keys: Sequence[str] = (PANEL,), value: str = VALUE) -> DataFrame:
    return features.join(complete_features(features, keys, value), [*keys, "feature"], "left_semi")


def candidate_features(train: DataFrame, test: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Feature names present in both splits and not added yet."""
    keys = [PANEL, "feature"]
    names = train.select(*keys).distinct().join(test.select(*keys).distinct(), keys, "left_semi")
    return names if added is None else names.join(added.select(*keys), keys, "left_anti")


def assign_feature(wide: DataFrame, features: DataFrame, feature: str, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Add one feature as a column, matched by panel and date."""
    keys = [PANEL, TS, *extra_keys]
    column = features.where(F.col("feature") == feature).select(*keys, F.col(VALUE).alias(feature))
    return wide.join(column, keys, "left")


def union_names(*names: DataFrame) -> DataFrame:
    out = names[0].select(PANEL, "feature")
    for other in names[1:]:
        out = out.unionByName(other.select(PANEL, "feature"))
    return out.distinct()
