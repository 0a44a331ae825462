import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import values_of
from tidepanel.functions.scalar import log100
from tidepanel.operators import clean, split, transform

GAPPY = [None, None, 3.0, None, 9.0, None, None, None, 1.0, None]


@pytest.mark.parametrize("block_days", [None, 40, 5000])
def test_fills_and_interpolation(spark, make_panel, block_days):
    panel = make_panel({"a": GAPPY, "b": [None] * 10, "c": list(range(10))})
    s = pd.Series(GAPPY, dtype=float)
    for fn, want in (
        (clean.forward_fill, s.ffill()),
        (clean.backward_fill, s.bfill()),
        (clean.interpolate_linear, s.interpolate("linear")),
    ):
        got = fn(panel, block_days=block_days)
        a = [np.nan if v is None else v for v in values_of(got.where("series_id = 'a'"))]
        np.testing.assert_allclose(a, want)
        assert values_of(got.where("series_id = 'b'")) == [None] * 10
        assert values_of(got.where("series_id = 'c'")) == list(range(10))


def test_forward_fill_twice_is_once(spark, make_panel):
    once = clean.forward_fill(make_panel({"a": GAPPY}))
    assert values_of(clean.forward_fill(once)) == values_of(once)


def test_clean_series(spark, make_panel):
    panel = make_panel({"a": [math.inf, 1.0, None, -math.inf, 4.0, math.nan], "b": [None] * 6})
    got = clean.clean_series(panel)
    assert values_of(got.where("series_id = 'a'")) == [1.0, 1.0, 4.0, 4.0, 4.0, 4.0]
    assert values_of(got.where("series_id = 'b'")) == [None] * 6


def test_cap_outliers_on_train_only(spark, make_panel):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 500.0, 900.0, -900.0]
    panel = split.chrono_split(make_panel({"a": values}))
    train = pd.Series(values[:8])
    q1, q3 = train.quantile(0.25), train.quantile(0.75)
    want = train.clip(q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)).tolist() + values[8:]
    assert values_of(clean.cap_outliers(panel)) == want
    bounds = clean.quartile_bounds(panel).first()
    assert (bounds["lower"], bounds["upper"]) == (q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))


def test_capping_leaves_null_alone(spark, make_panel):
    assert values_of(clean.cap_outliers(make_panel({"a": [1, None, 3], "b": [None] * 3}))) == [1, None, 3] + [None] * 3


def test_split_sizes(spark, make_panel):
    for n, test in ((577, 116), (10, 2), (11, 3), (5, 1), (2, 1)):
        got = split.chrono_split(make_panel({"a": range(n), "b": range(n)}))
        assert got.where("split = 'test'").count() == 2 * test
        edge = got.groupBy("split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
        span = {r["split"]: (r["lo"], r["hi"]) for r in edge}
        assert span["train"][1] < span["test"][0]


def test_log_of_zero_and_negative(spark, make_panel):
    got = values_of(make_panel({"a": [0.0, -1.0, math.e]}).withColumn("value", log100(F.col("value"))))
    assert got[:2] == [None, None] and got[2] == pytest.approx(100.0)


def test_standardise_train(spark, make_panel):
    panel = split.chrono_split(make_panel({"a": [1, 5, 2, 9, 100], "c": [7, 7, 7, 7, 8]}))
    z = transform.standardise(panel).where("split = 'train'")
    fit = z.groupBy("series_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    stats = {r["series_id"]: (r["m"], r["s"]) for r in fit}
    assert stats["a"] == pytest.approx((0, 1)) and stats["c"] == pytest.approx((0, 0))


@pytest.mark.parametrize("block_days", [None, 45])
def test_changes_match_pandas(spark, make_panel, block_days):
    values = [2.0, None, 4.0, 0.0, 5.0, -5.0, 1.0, 8.0, 3.0, 2.0, 6.0]
    panel = make_panel({"a": values})
    s = pd.Series(values).ffill()
    pct = (s.diff() / s.shift()).replace([np.inf, -np.inf], np.nan)
    got = [np.nan if v is None else v for v in values_of(transform.percent_change(panel, block_days=block_days))]
    np.testing.assert_allclose(got, pct)
    full = make_panel({"a": s})
    roll = s.rolling(7).mean()
    for then, want in ((False, s - roll), (True, (s - roll).diff())):
        got = values_of(transform.detrend(full, then_difference=then, block_days=block_days))
        np.testing.assert_allclose([np.nan if v is None else v for v in got], want, atol=1e-12)


def test_deflate(spark, make_panel):
    panel = make_panel({"n": [10, 20], "p": [50, 0], "r": [3, 4]})
    got = transform.deflate(panel, "p", ["n", "absent"])
    assert values_of(got) == [20.0, None, 50.0, 0.0, 3.0, 4.0]
    with pytest.raises(ValueError, match="deflator"):
        transform.deflate(panel, "zz", ["n"])


def test_hot_panel_and_partition_count(spark, make_panel):
    """One panel with most series gives the same split and values as any other,
    whatever the number of partitions."""
    series = {("hot", f"s{i}"): range(10) for i in range(60)} | {("cold", "s"): range(10)}
    panel = make_panel(series)
    seen = []
    for parts in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = transform.standardise(split.chrono_split(panel.repartition(int(parts))))
        df = df.withColumn("value", F.round("value", 9))
        seen.append(sorted(map(tuple, df.select("panel_id", "series_id", "ts", "split", "value").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 610


def test_unsorted_input(spark, make_panel):
    dates = [dt.date(2000, 3, 1), dt.date(2000, 1, 1), dt.date(2000, 2, 1)]
    assert values_of(transform.difference(make_panel({"a": [9, 1, 4]}, dates))) == [None, 3.0, 5.0]
