"""Order statistics, multiplicity, recursions and patterns of frames, against plain numpy frame by frame."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepanel.functions import calculators as calc
from tidepanel.functions.calculators import label
from tidepanel.operators import features, ranks

RNG = np.random.default_rng(3)
KEYS = ["panel_id", "series_id"]
SERIES = {
    "walk": RNG.normal(size=60).cumsum(),
    "ties": RNG.integers(0, 4, 60).astype(float),
    "flat": np.full(30, 2.5),
    "noise": RNG.normal(size=60) * 1e3 + 1e6,
    "short": np.array([1.0, -1.0, 1.0]),
}


def plain(x):
    """The calculators that are computed from running state, of one frame."""
    n, out = len(x), {}
    for q in calc.QUANTILES:
        out[label("quantile", q=q)] = float(np.quantile(x, q))
    values, counts = np.unique(x, return_counts=True)
    again = values[counts > 1]
    out["has_duplicate"] = float(len(values) < n)
    out["has_duplicate_max"] = float((x == x.max()).sum() > 1)
    out["has_duplicate_min"] = float((x == x.min()).sum() > 1)
    out["percentage_of_reoccurring_values_to_all_values"] = len(again) / len(values)
    out["percentage_of_reoccurring_datapoints_to_all_datapoints"] = counts[counts > 1].sum() / n
    out["sum_of_reoccurring_values"] = again.sum()
    out["sum_of_reoccurring_data_points"] = (values * counts)[counts > 1].sum()
    out["ratio_value_number_to_time_series_length"] = len(values) / n
    for k in calc.LARGEST:
        out[label("mean_n_absolute_max", number_of_maxima=k)] = float(np.sort(abs(x))[-k:].mean()) if n > k else None
    d, var = x - x.mean(), x.var()
    acf = lambda k: float(d[: n - k] @ d[k:]) / ((n - k) * var) if k < n and var > 1e-15 else None
    for k in range(calc.ACF_LAGS):
        out[label("autocorrelation", lag=k)] = acf(k)
    top = min(calc.PACF_LAGS - 1, n // 2 - 1)
    pacf, phi, error = [1.0] if n > 3 and var > 0 else [], np.zeros(0), float(d @ d) / n
    for k in range(1, top + 1 if pacf else 0):
        c = [float(d[: n - j] @ d[j:]) / (n - j) for j in range(k + 1)]
        r = (c[k] - phi @ np.array(c[k - 1 : 0 : -1])) / error
        phi, error = np.append(phi - r * phi[::-1], r), error * (1 - r * r)
        pacf.append(r)
    for k in range(calc.PACF_LAGS):
        out[label("partial_autocorrelation", lag=k)] = pacf[k] if k < len(pacf) else None
    k = calc.AR_ORDER
    beta = [None] * (k + 1)
    if n >= 2 * k + 1:
        rows = np.column_stack([np.ones(n - k)] + [x[k - j : n - j] for j in range(1, k + 1)])
        centred = rows[:, 1:] - rows[:, 1:].mean(0)
        if var > 0 and np.linalg.matrix_rank(centred, tol=1e-4 * np.linalg.norm(centred)) == k:
            beta = np.linalg.lstsq(rows, x[k:], rcond=None)[0].tolist()
    for i in range(k + 1):
        out[label("ar_coefficient", coeff=i, k=k)] = beta[i]
    for k in calc.PERMUTATION_DIMS:
        value = None
        if n >= k:
            orders = np.argsort(np.lib.stride_tricks.sliding_window_view(x, k), axis=1, kind="stable")
            p = np.unique(orders, axis=0, return_counts=True)[1] / len(orders)
            value = float(-(p * np.log(p)).sum())
        out[label("permutation_entropy", dimension=k, tau=1)] = value
    for size in calc.CHUNK_LENGTHS:
        for how in calc.CHUNK_AGGS:
            y = np.array([getattr(x[i : i + size], how)() for i in range(0, n, size)])
            parts = line(y) if n > size and len(y) > 1 else dict.fromkeys(calc.LINE)
            for attr in calc.LINE:
                out[label("agg_linear_trend", attr=attr, chunk_len=size, f_agg=how)] = parts[attr]
    out[label("linear_trend", attr="pvalue")] = None
    if n == 2:
        out[label("linear_trend", attr="pvalue")] = float(x[0] == x[1])
    elif n > 2:
        parts = line(x)
        t = parts["slope"] / parts["stderr"] if parts["stderr"] > 0 else (math.inf if parts["slope"] else 0.0)
        out[label("linear_trend", attr="pvalue")] = tail(t, n - 2)
    return out


def line(y):
    m = len(y)
    t = np.arange(m) - (m - 1) / 2
    sxx, syy, sxy = float(t @ t), float(((y - y.mean()) ** 2).sum()), float(t @ (y - y.mean()))
    if syy <= 1e-20 * max(1.0, float(y @ y)):
        return {"rvalue": 0.0, "intercept": float(y.mean()), "slope": 0.0, "stderr": 0.0}
    slope = sxy / sxx
    stderr = math.sqrt(max(syy - slope * sxy, 0.0) / sxx / (m - 2)) if m > 2 else 0.0
    return {"rvalue": sxy / math.sqrt(sxx * syy), "intercept": float(y.mean() - slope * (m - 1) / 2), "slope": slope, "stderr": stderr}


def tail(t, dof):
    """Two-sided tail of Student's t by the finite sums for whole degrees of freedom."""
    theta = math.atan2(abs(t), math.sqrt(dof)) if math.isfinite(t) else math.pi / 2
    c, s = math.cos(theta), math.sin(theta)
    term = total = c if dof % 2 else 1.0
    for j in range(3 if dof % 2 else 2, dof - 1, 2):
        term *= c * c * (j - 1) / j
        total += term
    inside = 2 * theta / math.pi if dof == 1 else 2 / math.pi * (theta + s * total) if dof % 2 else s * total
    return min(max(1 - inside, 0.0), 1.0)


def test_student_tail(spark):
    """Table values of Student's t, and the finite sums over many degrees."""
    cases = [(12.7062, 1.0, 0.05), (4.30265, 2.0, 0.05), (2.570582, 5.0, 0.05), (2.228139, 10.0, 0.05), (0.0, 5.0, 1.0)]
    cases += [(t, float(d), tail(t, d)) for t in (-0.1, 0.5, 1.3, 2.0, 4.0) for d in (1, 2, 3, 8, 57, 400, 5001)]
    rows = spark.createDataFrame(cases, "t double, dof double, want double")
    for r in rows.selectExpr("*", f"{calc.student_two_sided('t', 'dof')} as got").collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-6 if r["want"] == 0.05 else 1e-9), r


PICKED = [
    calc.ORDER[n] for n in calc.ORDER if "location" not in n
] + [calc.ARRAY["autocorrelation"], *calc.RECURSIVE.values()]


@pytest.mark.parametrize(("shift", "short"), [(None, 0), (None, 40), (None, 600), (0, 0), (24, 600), (24, 0), (300, 50)])
def test_frames(make_panel, monkeypatch, shift, short):
    monkeypatch.setattr(calc, "SHORT", short)
    got = features.extract_columns(make_panel(SERIES), PICKED, max_shift=shift)
    rows = got.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m")).orderBy("ts")
    checked = 0
    for end, row in enumerate(rows.collect(), start=1):
        for name, x in SERIES.items():
            if end > len(x):
                continue
            want = plain(x[max(0, end - 1 - shift) if shift is not None else 0 : end])
            mine = {k[len(name) + 2 :]: v for k, v in row["m"].items() if k.startswith(name + "__")}
            assert mine.keys() == want.keys()
            for feature, v in want.items():
                if name == "flat" and feature.startswith(("autocorr", "ar_", "partial")):
                    assert mine[feature] is None, (end, feature)
                elif feature.startswith("ar_") and (v is None or mine[feature] is None):
                    assert v is None or name == "ties", (end, name, feature, v, mine[feature])
                elif v is None:
                    assert mine[feature] is None, (end, name, feature)
                else:
                    # Products of lags lose about as many digits as their matrix is badly conditioned.
                    rel, room = (1e-3, 1e-3 * max(1.0, abs(v))) if feature.startswith(("ar_", "partial")) else (1e-7, 1e-7)
                    if "linear_trend" in feature:  # squares of values far from the first one
                        rel, room = 1e-5, 1e-5 * max(1.0, x.std())
                    assert mine[feature] == pytest.approx(v, rel=rel, abs=room), (end, name, feature)
                    checked += 1
    assert checked > 1000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([-2.0, 0.0, 1.0, 1.5, 7.0]), min_size=1, max_size=80), st.sampled_from([None, 0, 3, 40]))
def test_order_statistics_of_ties(spark, values, shift):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=3 * i) for i in range(len(values))]
    rows = spark.createDataFrame([("p", "s", d, v) for d, v in zip(days, values)], "panel_id string, series_id string, ts date, value double")
    got = ranks.order_statistics(rows, KEYS, F.sequence(F.lit(0), F.col("_len")), max_shift=shift, max_rows=100)
    found = {r["ts"]: r["places"] for r in got.collect()}
    for i, d in enumerate(days):
        frame = sorted(values[max(0, i - shift) if shift is not None else 0 : i + 1])
        assert [found[d][k] for k in range(len(frame))] == frame and len(found[d]) == len(frame)


def long_series(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n).cumsum(), 1)
    days = [dt.date(1900, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return x, spark.createDataFrame(pd.DataFrame({"panel_id": "p", "series_id": "s", "ts": days, "value": x}))


@pytest.mark.parametrize("shift", [None, 5000])
def test_long_series(spark, shift):
    """Quantiles of 20,000 frames of up to 20,000 rows."""
    x, rows = long_series(spark, 20_000)
    got = ranks.frame_quantiles(rows, KEYS, (0.1, 0.5, 0.9), max_shift=shift).orderBy("ts").collect()
    w = pd.Series(x).expanding() if shift is None else pd.Series(x).rolling(shift + 1, min_periods=1)
    want = np.stack([w.quantile(q).to_numpy() for q in (0.1, 0.5, 0.9)], 1)
    assert np.allclose([r["quantiles"] for r in got], want, atol=1e-9)


def test_too_long_a_series_is_an_error(spark):
    _, rows = long_series(spark, 40)
    with pytest.raises(Exception, match="more than 16 rows"):
        ranks.frame_quantiles(rows, KEYS, (0.5,), max_rows=16).collect()


def test_only_frames_of_short_series_are_gathered():
    f = calc.Frame(KEYS)
    pieces = [c(f) for c in PICKED]
    gathered = [sql for sql in f.aggregates.values() if "collect_list" in sql or "percentile" in sql]
    assert pieces and gathered and all(f"{calc.ROWS_COLUMN} <= {calc.SHORT}" in sql for sql in gathered)


def test_autoregression_recovers_its_coefficients(spark):
    x = np.zeros(4000)
    for i in range(1, 4000):
        x[i] = 0.7 * x[i - 1] + RNG.normal()
    days = [dt.date(1990, 1, 1) + dt.timedelta(days=i) for i in range(len(x))]
    rows = spark.createDataFrame(pd.DataFrame({"panel_id": "p", "series_id": "s", "ts": days, "value": x}))
    got = features.extract_columns(rows, [calc.RECURSIVE["ar_coefficient"], calc.RECURSIVE["partial_autocorrelation"]])
    last = {r["feature"][3:]: r["value"] for r in got.where(F.col("ts") == days[-1]).collect()}
    assert last[label("ar_coefficient", coeff=1, k=10)] == pytest.approx(0.7, abs=0.06)
    assert last[label("partial_autocorrelation", lag=1)] == pytest.approx(0.7, abs=0.05)
    assert abs(last[label("partial_autocorrelation", lag=3)]) < 0.06 and not math.isnan(last[label("ar_coefficient", coeff=0, k=10)])


@pytest.mark.parametrize("shift", [0, 1, 6, 15])
def test_sliding_fourier(make_panel, shift):
    x = {"walk": RNG.normal(size=50).cumsum() * 100 + 1e4, "flat": np.full(20, 3.0), "noise": RNG.normal(size=50)}
    got = features.extract_columns(make_panel(x), calc.SPECTRAL.values(), max_shift=shift)
    rows = got.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m")).orderBy("ts")
    for end, row in enumerate(rows.collect(), start=1):
        for name, values in x.items():
            if end > len(values):
                continue
            frame = values[max(0, end - 1 - shift) : end]
            z, scale = np.fft.rfft(frame), max(1.0, abs(frame).max())
            for attr, part in (("real", z.real), ("imag", z.imag), ("abs", abs(z)), ("angle", np.degrees(np.angle(z)))):
                for k in calc.FFT_COEFFS:
                    v = row["m"][f"{name}__" + label("fft_coefficient", attr=attr, coeff=k)]
                    if k >= len(z):
                        assert v is None
                    elif attr != "angle":
                        assert v == pytest.approx(part[k], abs=1e-9 * scale)
                    elif abs(z[k]) > 1e-6 * scale:
                        assert abs((v - part[k] + 180) % 360 - 180) < 1e-5
            y = abs(z)
            centroid = row["m"][f"{name}__" + label("fft_aggregated", aggtype="centroid")]
            assert centroid == pytest.approx((y * np.arange(len(y))).sum() / y.sum(), abs=1e-8)


def test_rolling_sets_slide(make_panel):
    columns, names = features.calculators_for("efficient", 11)
    assert set(calc.SPECTRAL.values()) <= set(columns) and not set(names) & set(calc.SPECTRAL)
    assert set(calc.SPECTRAL) <= set(features.calculators_for("efficient")[1])
