"""Series catalog: source frequency and the roles a series plays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.keys import CATALOG_SCHEMA

DEFAULT_FREQ = "m"

# The public identifiers of the default monthly macro panel, with
# its date range, source frequencies and role lists.
DEFAULT_SERIES = (
    "FEDFUNDS", "GDP", "CPIAUCSL", "CUSR0000SAH1", "CPILFESL", "PCE", "PRFI", "PNFI", "EXPGS", "HOUST", "DSPI",
    "DGS2", "DGS5", "DGS10", "AAA", "BAA", "WTISPLC", "IMPGS", "GCE", "FGCE", "GDPCTPI", "PCEPI", "PCEPILFE",
    "PAYEMS", "UNRATE", "INDPRO", "CUMFNS", "USREC",
)
DEFAULT_START = "1976-01-01"
DEFAULT_END = "2024-01-01"
DAILY = ("DGS2", "DGS5", "DGS10")
QUARTERLY = ("GDP", "PRFI", "PNFI", "EXPGS", "IMPGS", "GCE", "FGCE", "GDPCTPI")
NOMINAL = ("GDP", "PCE", "PRFI", "PNFI", "EXPGS", "IMPGS", "GCE", "FGCE", "DSPI")
LOGGED = (*NOMINAL, "HOUST")
DEFLATOR = "CPIAUCSL"


def catalog_rows(
    series: Iterable[str],
    *,
    daily: Iterable[str] = (),
    quarterly: Iterable[str] = (),
    nominal: Iterable[str] = (),
    log: Iterable[str] = (),
    spline: Iterable[str] = (),
) -> list[tuple[str, str, bool, bool, bool]]:
    daily, quarterly, nominal, log, spline = map(set, (daily, quarterly, nominal, log, spline))
    freq = lambda s: "d" if s in daily else "q" if s in quarterly else DEFAULT_FREQ
    return [(s, freq(s), s in nominal, s in log, s in spline) for s in series]


def default_catalog(spark: SparkSession) -> DataFrame:
    rows = catalog_rows(
        DEFAULT_SERIES,
        daily=DAILY,
        quarterly=QUARTERLY,
        nominal=NOMINAL,
        log=LOGGED,
        spline=(*QUARTERLY, *DAILY),
    )
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def make_catalog(spark: SparkSession, series: Iterable[str], **roles: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(catalog_rows(series, **roles), CATALOG_SCHEMA)
