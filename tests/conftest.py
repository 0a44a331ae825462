import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepanel.keys import PANEL_SCHEMA  # noqa: E402
from tidepanel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=8)
    yield session
    session.stop()


def months(n, start=(2000, 1)):
    y, m = start
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="session")
def make_panel(spark):
    """Panel from {series: values} or {(panel, series): values} on month starts."""

    def make(series, dates=None):
        rows = []
        for key, values in series.items():
            panel, name = key if isinstance(key, tuple) else ("all", key)
            for ts, v in zip(dates or months(len(values)), values):
                rows.append((panel, name, ts, None if v is None else float(v)))
        return spark.createDataFrame(rows, PANEL_SCHEMA)

    return make


def values_of(df, column="value", order=("panel_id", "series_id", "ts")):
    keys = [c for c in order if c in df.columns]
    return [r[column] for r in df.orderBy(*keys).select(*keys, column).collect()]
