import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import values_of
from tidepanel.functions import adf, adf_sql, spline
from tidepanel.operators import impute, split, stationarity


def dense_spline(x, y, at):
    """Not-a-knot spline from one dense system in the piece coefficients."""
    n = len(x)
    rows, rhs = [], []

    def row(pairs, value):
        r = np.zeros(4 * (n - 1))
        for i, c in pairs:
            r[i] = c
        rows.append(r)
        rhs.append(value)

    for i in range(n - 1):
        h = x[i + 1] - x[i]
        row([(4 * i, 1)], y[i])
        row([(4 * i + k, h**k) for k in range(4)], y[i + 1])
        if i < n - 2:
            row([(4 * i + 1, 1), (4 * i + 2, 2 * h), (4 * i + 3, 3 * h * h), (4 * i + 5, -1)], 0)
            row([(4 * i + 2, 2), (4 * i + 3, 6 * h), (4 * i + 6, -2)], 0)
    row([(3, 1), (7, -1)], 0)
    row([(4 * (n - 2) + 3, 1), (4 * (n - 3) + 3, -1)], 0)
    c = np.linalg.solve(np.array(rows), np.array(rhs)).reshape(-1, 4)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[i]
    return c[i, 0] + c[i, 1] * t + c[i, 2] * t**2 + c[i, 3] * t**3


@pytest.mark.parametrize("n", [4, 5, 9, 30])
def test_spline_equals_dense_solve(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.uniform(0.5, 3.0, n))
    y = rng.normal(size=n)
    at = np.linspace(x[0] - 1, x[-1] + 1, 57)
    got = spline.evaluate(x, y, spline.second_derivatives(x, y), at)
    np.testing.assert_allclose(got, dense_spline(x, y, at), rtol=1e-7, atol=1e-7)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=4, max_size=4), st.integers(2, 12), st.integers(0, 10**6))
def test_spline_reproduces_polynomials(coef, n, seed):
    degree = min(n - 1, 3)
    x = np.cumsum(np.random.default_rng(seed).uniform(1, 4, n))
    poly = np.polynomial.Polynomial(coef[: degree + 1])
    y = poly(x)
    y_gap = np.concatenate([y, [np.nan, np.nan]])
    full_x = np.concatenate([x, [x[0] - 1.5, x[-1] + 1.5]])
    out = spline.fill_gaps(full_x, y_gap)
    np.testing.assert_allclose(out[:-2], y)
    np.testing.assert_allclose(out[-2:], poly(full_x[-2:]), rtol=1e-6, atol=1e-4)


def test_fewer_than_two_points_stay(spark, make_panel):
    got = impute.spline_impute(make_panel({"a": [None, 3, None], "b": [None] * 3, "c": [1, None, 5]}))
    assert values_of(got)[:6] == [None, 3, None, None, None, None]
    assert values_of(got.where("series_id = 'c'"))[1] == pytest.approx(1 + 4 * 31 / 60)


def test_only_named_series_and_per_split(spark, make_panel):
    values = [1, None, 4, 9, None, 30, 7, 1, None, 2]
    panel = split.chrono_split(make_panel({"a": values, "b": values}))
    got = impute.spline_impute(panel, series=["a"])
    assert values_of(got.where("series_id = 'b'")) == values
    a = values_of(got.where("series_id = 'a' and split = 'test'"))
    assert a == [None, 2.0]  # one known point in the test split is no line


def test_blocked_spline_equals_whole(spark, make_panel):
    rng = np.random.default_rng(3)
    values = [v if i % 3 == 0 else None for i, v in enumerate(rng.normal(size=600).cumsum())]
    panel = make_panel({"a": values, "b": values[::-1]})
    whole, cut = (values_of(impute.spline_impute(panel, block_days=d)) for d in (None, 700))
    np.testing.assert_allclose(cut, whole, rtol=1e-10, atol=1e-10)


# --- Dickey-Fuller ---------------------------------------------------------------------


def plain_adf(y):
    """Direct least squares for every lag."""
    n = len(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    dy = np.diff(y)

    def fit(lag, start):
        t = np.arange(start, n)
        cols = [np.ones(len(t)), y[t - 1]] + [dy[t - 1 - k] for k in range(1, lag + 1)]
        x, z = np.column_stack(cols), dy[t - 1]
        beta, *_ = np.linalg.lstsq(x, z, rcond=None)
        rss = float(((z - x @ beta) ** 2).sum())
        se = math.sqrt(rss / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        aic = len(t) * math.log(rss / len(t)) + 2 * x.shape[1]
        return beta[1] / se, aic, len(t)

    best = min(range(top + 1), key=lambda k: fit(k, top + 1)[1])
    stat, _, nobs = fit(best, best + 1)
    return stat, best, nobs


@pytest.mark.parametrize("n,level", [(12, 0), (40, 3), (116, 0), (461, 5000)])
def test_adf_equals_direct_fits(n, level):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        y = level + rng.normal(size=n).cumsum()
        stat, lag, nobs = adf.adf(y)
        want = plain_adf(y)
        assert (lag, nobs) == want[1:] and stat == pytest.approx(want[0], rel=1e-6)


def test_adf_in_sql_equals_direct_fits(spark, make_panel):
    """Statistic, lag and rows of arrays in Spark, and the p-value and critical values beside them."""
    series = {}
    for n, level in ((12, 0), (40, 3), (116, 0), (461, 5000)):
        for seed in range(4):
            noise = np.random.default_rng(seed).normal(size=n)
            series[f"s{n}_{seed}"] = level + (noise.cumsum() if seed % 2 else noise)
    series |= {"flat": [2.0] * 30, "tiny": [1.0, 4.0, 2.0], "line": list(range(40)), "gap": [None, 3.0, None]}
    got = {r["series_id"]: r for r in stationarity.adf_report(make_panel(series)).collect()}
    for name, y in series.items():
        if name in ("flat", "tiny", "line", "gap"):
            assert got[name]["adf_stat"] is None and got[name]["used_lag"] is None and got[name]["p_value"] is None
            continue
        stat, lag, nobs = plain_adf(np.asarray(y))
        r = got[name]
        assert (r["used_lag"], r["nobs"]) == (lag, nobs) and r["adf_stat"] == pytest.approx(stat, rel=1e-6)
        assert r["p_value"] == pytest.approx(adf.p_value(r["adf_stat"]), rel=1e-9, abs=1e-15)
        assert r["crit_5"] == pytest.approx(adf.critical_value(5, nobs))


def test_normal_distribution_in_sql(spark):
    z = [-37.0, -9.0, -4.0, -2.51, -2.5, -2.49, -1.0, 0.0, 0.5, 2.0, 2.51, 4.0, 7.0]
    frame = spark.createDataFrame([(x,) for x in z], "z double")
    for r in frame.selectExpr("z", f"{adf_sql.normal_below('z')} as p").collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=1e-10, abs=1e-300)


def test_adf_undefined():
    assert adf.adf(np.full(30, 2.0)) is None
    assert adf.adf(np.arange(3.0)) is None


def test_p_values_and_critical_values():
    # Asymptotic critical values of the constant-only case and their tail shares.
    for percent in (1, 5, 10):
        crit = adf.critical_value(percent, 10**9)
        assert adf.p_value(crit) == pytest.approx(percent / 100, abs=2e-3)
    assert adf.p_value(-30) == 0.0 and adf.p_value(5) == 1.0


@pytest.mark.parametrize("block_days", [200, 1000, 4000])
def test_blocked_adf_equals_whole(spark, make_panel, block_days):
    rng = np.random.default_rng(0)
    panel = make_panel({f"s{i}": rng.normal(size=n).cumsum() for i, n in enumerate((12, 40, 120, 300))})
    key = lambda df: sorted(map(tuple, df.select("series_id", "used_lag", "nobs").collect()))
    whole, cut = stationarity.adf_report(panel), stationarity.adf_report(panel, block_days=block_days)
    assert key(whole) == key(cut)
    np.testing.assert_allclose(values_of(cut, "adf_stat"), values_of(whole, "adf_stat"), rtol=1e-8)


def test_constant_and_short_series_choose_none(spark, make_panel):
    panel = make_panel({"flat": [5] * 30, "tiny": [1, 4, 2]})
    for how in ("autolag", "lag0"):
        choice = {r["series_id"]: r["method"] for r in stationarity.choose_transform(panel, statistic=how).collect()}
        assert choice == {"flat": "None", "tiny": "None"} or how == "lag0" and choice["flat"] == "None"


@pytest.mark.parametrize("statistic", ["autolag", "lag0"])
def test_apply_equals_choice_in_every_form(spark, make_panel, statistic):
    rng = np.random.default_rng(7)
    panel = make_panel({"walk": rng.normal(size=80).cumsum(), "noise": rng.normal(size=80)})
    inline = stationarity.apply_transform(panel, statistic=statistic)
    choice = stationarity.choose_transform(panel, statistic=statistic)
    joined = stationarity.apply_transform(panel, choice)
    blocked = stationarity.apply_transform(panel, statistic=statistic, block_days=365)
    for other in (joined, blocked):
        np.testing.assert_allclose(values_of(other), values_of(inline), atol=1e-12)
        assert values_of(other, "method") == values_of(inline, "method")
    assert None not in values_of(inline)
