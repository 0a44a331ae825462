"""Column names and schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

PANEL = "panel_id"
SERIES = "series_id"
TS = "ts"
VALUE = "value"
SPLIT = "split"

SERIES_KEY = (PANEL, SERIES)
ROW_KEY = (PANEL, SERIES, TS)
SPLIT_KEY = (PANEL, SERIES, SPLIT)

PANEL_SCHEMA = T.StructType(
    [
        T.StructField(PANEL, T.StringType()),
        T.StructField(SERIES, T.StringType()),
        T.StructField(TS, T.DateType()),
        T.StructField(VALUE, T.DoubleType()),
    ]
)

FEATURES_SCHEMA = T.StructType(
    [
        T.StructField(PANEL, T.StringType()),
        T.StructField(TS, T.DateType()),
        T.StructField("feature", T.StringType()),
        T.StructField(VALUE, T.DoubleType()),
    ]
)

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField(SERIES, T.StringType()),
        T.StructField("freq", T.StringType()),
        T.StructField("nominal", T.BooleanType()),
        T.StructField("log", T.BooleanType()),
        T.StructField("spline", T.BooleanType()),
    ]
)
