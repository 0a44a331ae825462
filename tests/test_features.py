import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import calculators as calc
from tidepanel.functions import frame_numpy as fn
from tidepanel.functions.calculators import label
from tidepanel.operators import features, split

RNG = np.random.default_rng(11)
X = RNG.normal(size=40).cumsum()


def numbers(name, x):
    labels, f = fn.ALL[name]
    return dict(zip(labels, f(np.asarray(x, dtype=float))))


def test_labels():
    assert label("quantile", q=0.1) == "quantile__q_0.1"
    assert label("agg_autocorrelation", maxlag=40, f_agg="mean") == 'agg_autocorrelation__f_agg_"mean"__maxlag_40'


def test_unknown_set():
    with pytest.raises(ValueError):
        features.calculators_for("everything")
    assert len(features.calculators_for("minimal")[0]) == 10
    assert set(features.calculators_for("comprehensive")[1]) - set(features.calculators_for("efficient")[1]) == set(fn.COSTLY)


def test_features_do_not_see_the_future(spark, make_panel):
    full = make_panel({"a": X, "b": X[::-1]})
    cut = full.where(F.col("ts") < "2002-01-01")
    columns = [c for registry in calc.COLUMN_SETS["efficient"] for c in registry.values()]
    early = features.extract_columns(full, columns).where(F.col("ts") < "2002-01-01")
    assert early.exceptAll(features.extract_columns(cut, columns)).count() == 0


def test_wide_rolling_frame_equals_expanding(spark, make_panel):
    panel = make_panel({"a": X, "b": np.round(X)})
    columns = [c for registry in calc.COLUMN_SETS["efficient"] for c in registry.values()]
    both = [
        df.withColumn("value", F.round("value", 8))
        for df in (features.extract_columns(panel, columns), features.extract_columns(panel, columns, max_shift=len(X)))
    ]
    assert both[0].exceptAll(both[1]).count() == 0


def test_rolling_frame_equals_frame_taken_alone(spark, make_panel):
    """The last rolling frame equals the last expanding frame of those rows."""
    k = 15
    columns = [c for registry in calc.COLUMN_SETS["efficient"] for c in registry.values()]
    dates = make_panel({"a": X}).orderBy("ts").collect()
    last = dates[-1]["ts"]
    tail = make_panel({"a": X[-k - 1 :]}, [r["ts"] for r in dates[-k - 1 :]])
    pick = lambda df: {r["feature"]: r["value"] for r in df.where(F.col("ts") == last).collect()}
    rolled = pick(features.extract_columns(make_panel({"a": X}), columns, max_shift=k))
    alone = pick(features.extract_columns(tail, columns))
    assert rolled.keys() == alone.keys()
    for name, v in alone.items():
        assert rolled[name] == (v if v is None else pytest.approx(v, abs=1e-9)), name


def test_runs_of_frames_equal_direct_calls(spark, make_panel):
    x = RNG.normal(size=75).cumsum()
    for shift in (None, 9, 50):
        got = features.extract_arrays(make_panel({"a": x}), ["fft_coefficient", "fft_aggregated"], max_shift=shift)
        rows = got.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m")).orderBy("ts")
        for end, row in enumerate(rows.collect(), start=1):
            start = 0 if shift is None else max(0, end - 1 - shift)
            want = numbers("fft_coefficient", x[start:end]) | numbers("fft_aggregated", x[start:end])
            for name, v in want.items():
                g = row["m"]["a__" + name]
                assert (g is None) == (not math.isfinite(v)) and (g is None or g == pytest.approx(v, abs=1e-9)), (end, name)


def test_split_starts_anew(spark, make_panel):
    parted = split.chrono_split(make_panel({"a": range(10)}))
    got = features.extract(parted, "minimal").where("feature = 'a__length'").orderBy("ts")
    assert [r["value"] for r in got.collect()] == [1, 2, 3, 4, 5, 6, 7, 8, 1, 2]


def test_target_left_out(spark, make_panel):
    panel = make_panel({"a": [1, 2], "t": [3, 4]})
    names = {r[0] for r in features.extract(panel, target="t", include_target=False).select("feature").distinct().collect()}
    assert names and all(n.startswith("a__") for n in names)


# --- numpy calculators against plain definitions ------------------------------------------


def test_fourier():
    got = numbers("fft_coefficient", X)
    n = len(X)
    for k in (0, 3, 20):
        z = sum(v * np.exp(-2j * np.pi * k * t / n) for t, v in enumerate(X))
        assert got[label("fft_coefficient", attr="real", coeff=k)] == pytest.approx(z.real)
        assert got[label("fft_coefficient", attr="abs", coeff=k)] == pytest.approx(abs(z))
    assert math.isnan(got[label("fft_coefficient", attr="abs", coeff=21)])


def test_welch_keeps_the_power_of_a_sine():
    t = np.arange(512)
    power = fn.welch(np.sin(2 * np.pi * t / 8))
    assert power.argmax() == 32 and power.sum() / 256 == pytest.approx(0.5, rel=1e-6)


def test_entropies():
    assert numbers("sample_entropy", np.zeros(20))["sample_entropy"] == pytest.approx(-math.log((18 * 17) / (19 * 18)))
    assert all(v >= 0 for v in numbers("approximate_entropy", X).values())
    lz = numbers("lempel_ziv_complexity", [1, 2] * 16)
    assert lz[label("lempel_ziv_complexity", bins=2)] < 0.4


def test_short_frames_do_not_fail():
    for n in (1, 2, 3, 4):
        for name in fn.ALL:
            with np.errstate(all="ignore"):
                assert len(numbers(name, np.arange(n) % 2)) == len(fn.ALL[name][0])
    for name in fn.ALL:
        with np.errstate(all="ignore"):
            numbers(name, np.full(30, 2.0))
