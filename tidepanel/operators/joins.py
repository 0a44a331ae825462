"""Joins that keep their balance when one panel or date holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.keys import PANEL, SERIES, SERIES_KEY, TS

#: Names of series, or a table of them (series_id).
Names = Sequence[str] | DataFrame

SALTS = 32


def attach(
    rows: DataFrame,
    attributes: DataFrame,
    on: Sequence[str],
    *,
    how: str = "left",
    salt_by: Sequence[str] = SERIES_KEY,
    salts: int = SALTS,
) -> DataFrame:
    """Join one attribute row per key onto many rows per key.

    The attribute side is repeated ``salts`` times and the rows are dealt over
    those copies by a hash of ``salt_by``, so a panel holding a third of all rows
    is spread over ``salts`` tasks. No side is forced into a broadcast: Spark
    picks one only while the attribute side is below its size threshold.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    copies = attributes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def by_series(df: DataFrame, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Re-deal rows by series.

    A join on the panel alone leaves all series of a panel in one partition, and
    Spark would accept that for the per-series windows that follow.
    """
    return df.repartition(*[F.col(k) for k in keys])



def named(names: Names | None) -> bool:
    """Whether any names are given; a table counts as given, whatever it holds."""
    return names is not None and (isinstance(names, DataFrame) or len(names) > 0)


def with_flag(panel: DataFrame, names: Names, flag: str) -> DataFrame:
    """Add ``flag``: whether the row's series is among ``names``. A table of names is joined, however long it
    is, and its names may repeat."""
    if not isinstance(names, DataFrame):
        return panel.withColumn(flag, F.col(SERIES).isin(*names))
    table = names.select(SERIES).distinct().withColumn(flag, F.lit(True))
    joined = attach(panel, table, [SERIES], salt_by=[PANEL, TS])  # the key comes first there
    return joined.select(*panel.columns, F.coalesce(flag, F.lit(False)).alias(flag))
