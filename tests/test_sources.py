import datetime as dt

import pytest

from conftest import values_of
from tidepanel.keys import PANEL_SCHEMA
from tidepanel.operators import align
from tidepanel.sources import catalog, panel_io


def test_formats_round_trip(spark, make_panel, tmp_path):
    panel = make_panel({"a": [1.5, None, -3.0], "b": [0.1, 0.2, 0.3]})
    for fmt in panel_io.FORMATS:
        path = str(tmp_path / fmt)
        panel_io.write_panel(panel, path, fmt=fmt)
        assert values_of(panel_io.read_panel(spark, path, fmt=fmt)) == values_of(panel)


def test_partitioned_write_prunes(spark, make_panel, tmp_path):
    path = str(tmp_path / "p")
    panel_io.write_panel(make_panel({("x", "a"): [1], ("y", "a"): [2]}), path, partition_by=["panel_id"])
    plan = spark.read.parquet(path).where("panel_id = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(panel_id" in plan


def test_date_range_is_pushed_to_the_scan(spark, make_panel, tmp_path):
    path = str(tmp_path / "p")
    panel_io.write_panel(make_panel({"a": range(12)}), path)
    df = panel_io.read_panel(spark, path, start="2000-03-01", end="2000-05-01")
    assert df.count() == 3
    assert "GreaterThanOrEqual(ts,2000-03-01)" in df._jdf.queryExecution().toString()


def test_nan_and_infinity_become_null(spark):
    rows = [("all", "a", dt.date(2000, 1, i + 1), v) for i, v in enumerate([float("nan"), float("inf"), 1.0])]
    assert values_of(panel_io.normalise(spark.createDataFrame(rows, PANEL_SCHEMA))) == [None, None, 1.0]


def test_repeated_date_fails(spark, make_panel):
    panel = make_panel({"a": [1, 2]})
    assert panel_io.one_row_per_date(panel).count() == 2
    with pytest.raises(Exception, match="repeated date"):
        panel_io.one_row_per_date(panel.union(panel)).collect()


def test_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Date,a,b\n2000-01-01,1.0,\n2000-02-01,,4.5\n")
    long = panel_io.read_wide_csv(spark, str(tmp_path / "w.csv"), ["a", "b"])
    assert values_of(long) == [1.0, None, None, 4.5]


def test_params_round_trip(spark, tmp_path):
    params = {"xgboost": {"max_depth": 6.0, "learning_rate": 0.03386166645147473}, "lightgbm": {"num_leaves": 290.0}}
    panel_io.write_params(spark, params, str(tmp_path / "p"))
    assert panel_io.read_params(spark, str(tmp_path / "p")) == params


def test_default_catalog(spark):
    rows = {r["series_id"]: r for r in catalog.default_catalog(spark).collect()}
    assert len(rows) == 28
    assert (rows["GDP"]["freq"], rows["DGS2"]["freq"], rows["USREC"]["freq"]) == ("q", "d", "m")
    assert rows["HOUST"]["log"] and not rows["HOUST"]["nominal"]
    assert sum(r["spline"] for r in rows.values()) == 11


def test_month_grid_rounds_the_start_up(spark, make_panel):
    dates = [dt.date(2000, 1, 15), dt.date(2000, 2, 1), dt.date(2000, 4, 1)]
    grid = align.month_grid(make_panel({"a": [1, 2, 3]}, dates)).orderBy("ts").collect()
    assert [(r["ts"].month, r["value"]) for r in grid] == [(2, 2.0), (3, None), (4, 3.0)]


def test_month_grid_keeps_a_series_without_month_starts(spark, make_panel):
    panel = make_panel({"a": [1, 2]}).union(make_panel({"b": [5]}, [dt.date(2000, 1, 9)]))
    grid = align.month_grid(panel).where("series_id = 'b'")
    assert values_of(grid) == [None, None]


def test_full_range_grid_has_577_points(spark, make_panel):
    panel = make_panel({"a": [1, 2]}, [dt.date(1976, 1, 1), dt.date(2024, 1, 1)])
    assert align.month_grid(panel).count() == 577


def test_resample_methods(spark, make_panel):
    panel = make_panel({"a": [1, 2, 6, None]})
    for method, want in (("avg", 3.0), ("sum", 9.0), ("last", 6.0)):
        assert values_of(align.resample(panel, "q", method))[0] == want
    with pytest.raises(ValueError):
        align.resample(panel, "w")


def test_target_must_exist(spark, make_panel):
    panel = make_panel({"b": [1], "a": [2]})
    align.require_target(panel, "a")
    with pytest.raises(ValueError, match="a, b"):
        align.require_target(panel, "z")
    with pytest.raises(ValueError, match="no target"):
        align.require_target(panel, "")
