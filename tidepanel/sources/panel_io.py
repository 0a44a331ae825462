"""Reading and writing panels and the small result tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.scalar import known
from tidepanel.keys import PANEL, PANEL_SCHEMA, ROW_KEY, SERIES, TS, VALUE

FORMATS = ("parquet", "csv", "orc", "json")


def read_panel(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    fmt: str = "parquet",
    start: str | None = None,
    end: str | None = None,
    series: Sequence[str] | None = None,
) -> DataFrame:
    """Long panel from files, never with an inferred schema.

    The date range and the series list reach the parquet/ORC scan as pushed
    filters.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {', '.join(FORMATS)}")
    reader = spark.read.schema(PANEL_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path if isinstance(path, str) else list(path))
    return normalise(select_observations(df, start=start, end=end, series=series))


def select_observations(
    df: DataFrame,
    *,
    start: str | None = None,
    end: str | None = None,
    series: Sequence[str] | None = None,
) -> DataFrame:
    """Observations of the wanted series between two dates, both included."""
    if start is not None:
        df = df.where(F.col(TS) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(TS) <= F.lit(end).cast("date"))
    if series is not None:
        df = df.where(F.col(SERIES).isin(*series))
    return df


def normalise(df: DataFrame) -> DataFrame:
    """Cast to the panel schema; NaN and infinities become NULL."""
    return df.select(
        F.col(PANEL).cast("string"),
        F.col(SERIES).cast("string"),
        F.col(TS).cast("date"),
        known(F.col(VALUE).cast("double")).alias(VALUE),
    )


def one_row_per_date(panel: DataFrame) -> DataFrame:
    """Fail the job on a repeated (panel, series, date); otherwise pass through.

    Partial aggregation folds repeats before the shuffle, so even a key repeated
    billions of times stays small.
    """
    message = F.concat_ws(" ", F.lit("repeated date in series"), *[F.col(k).cast("string") for k in ROW_KEY])
    checked = F.when(F.count(F.lit(1)) > 1, F.raise_error(message).cast("double")).otherwise(F.first(VALUE))
    return panel.groupBy(*ROW_KEY).agg(checked.alias(VALUE))


def read_wide_csv(
    spark: SparkSession, path: str, columns: Sequence[str], *, date_column: str = "Date", panel: str = "all"
) -> DataFrame:
    """Wide CSV (a date column and one column per series) to a long panel."""
    schema = T.StructType(
        [T.StructField(date_column, T.DateType())] + [T.StructField(c, T.DoubleType()) for c in columns]
    )
    wide = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return unpivot_wide(wide.withColumnRenamed(date_column, TS).withColumn(PANEL, F.lit(panel)), columns)


def unpivot_wide(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide to long; a NULL cell stays a row with a NULL value."""
    long = wide.unpivot([PANEL, TS], list(columns), SERIES, VALUE)
    return normalise(long)


def write_panel(
    df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Iterable[str] = (), mode: str = "overwrite"
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    keys = list(partition_by)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.save(path)


def write_bucketed(df: DataFrame, table: str, *, buckets: int, mode: str = "overwrite") -> None:
    """Table bucketed and sorted by series: later per-series windows on it need
    no shuffle."""
    (
        df.write.mode(mode)
        .bucketBy(buckets, PANEL, SERIES)
        .sortBy(PANEL, SERIES, TS)
        .format("parquet")
        .saveAsTable(table)
    )


PARAMS_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def write_params(spark: SparkSession, params: dict[str, dict[str, float]], path: str) -> None:
    rows = [(m, n, float(v)) for m, p in sorted(params.items()) for n, v in sorted(p.items())]
    spark.createDataFrame(rows, PARAMS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """A handful of rows: one per model parameter."""
    out: dict[str, dict[str, float]] = {}
    for row in spark.read.schema(PARAMS_SCHEMA).json(path).collect():
        out.setdefault(row["model"], {})[row["name"]] = row["value"]
    return out


