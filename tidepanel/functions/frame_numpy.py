"""Calculators that need a transform, a solve or a sort per frame.

Each is a short numpy function of one frame, run inside the tasks of
``operators.features.extract_arrays``. NaN marks an undefined number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions import adf as ols
from tidepanel.functions.calculators import FFT_ATTRS, FFT_COEFFS, MOMENTS, label

NAN = float("nan")

# The parameter grids of the published calculator sets.
ENTROPY_BINS = (2, 3, 5, 10, 100)
WELCH_COEFFS = (2, 5, 8)
WIDTHS = (2, 5, 10, 20)
CWT_COEFFS = range(15)
DRIFT_DEGREE, DRIFT_BINS = 3, 30
TOLERANCES = (0.1, 0.3, 0.5, 0.7, 0.9)

Fn = Callable[[np.ndarray], Sequence[float]]
EFFICIENT: dict[str, tuple[list[str], Fn]] = {}
COSTLY: dict[str, tuple[list[str], Fn]] = {}


def _add(registry: dict, name: str, labels: Sequence[str]):
    def add(fn: Fn) -> Fn:
        registry[name] = (list(labels), fn)
        return fn

    return add


def padded(values: Sequence[float], picks: Sequence[int]) -> list[float]:
    return [float(values[i]) if i < len(values) else NAN for i in picks]


def binned_entropy(x: np.ndarray, bins: int) -> float:
    counts, _ = np.histogram(x, bins=bins)
    p = counts[counts > 0] / len(x)
    return float(-(p * np.log(p)).sum())


@_add(EFFICIENT, "fft_coefficient", [label("fft_coefficient", attr=a, coeff=k) for a in FFT_ATTRS for k in FFT_COEFFS])
def fft_coefficient(x):
    f = np.fft.rfft(x)
    parts = (f.real, f.imag, np.abs(f), np.degrees(np.angle(f)))
    return [v for p in parts for v in padded(p, FFT_COEFFS)]


@_add(EFFICIENT, "fft_aggregated", [label("fft_aggregated", aggtype=m) for m in MOMENTS])
def fft_aggregated(x):
    """Moments of the absolute spectrum over the coefficient index."""
    y = np.abs(np.fft.rfft(x))
    if y.sum() == 0:
        return [NAN] * 4
    i = np.arange(len(y), dtype=float)
    m1, m2, m3, m4 = (float((y * i**k).sum() / y.sum()) for k in (1, 2, 3, 4))
    var = m2 - m1 * m1
    if var < 0.5:
        return [m1, var, NAN, NAN]
    skew = (m3 - 3 * m1 * var - m1**3) / var**1.5
    # The last term is the first moment itself, as published.
    kurt = (m4 - 4 * m1 * m3 + 6 * m2 * m1**2 - 3 * m1) / var**2
    return [m1, var, skew, kurt]


def welch(x: np.ndarray) -> np.ndarray:
    """Power density by averaged Hann windows with half overlap, mean removed."""
    size = min(len(x), 256)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    step = size - size // 2
    runs = [x[i : i + size] for i in range(0, len(x) - size + 1, step)]
    power = np.mean([np.abs(np.fft.rfft((r - r.mean()) * window)) ** 2 for r in runs], axis=0) / (window**2).sum()
    last = None if size % 2 else -1
    power[1:last] *= 2
    return power


@_add(EFFICIENT, "spkt_welch_density", [label("spkt_welch_density", coeff=k) for k in WELCH_COEFFS])
def spkt_welch_density(x):
    return padded(welch(x), WELCH_COEFFS)


@_add(EFFICIENT, "fourier_entropy", [label("fourier_entropy", bins=b) for b in ENTROPY_BINS])
def fourier_entropy(x):
    power = welch(x)
    top = power.max()
    return [binned_entropy(power / top, b) if top > 0 else NAN for b in ENTROPY_BINS]


def ricker(points: int, width: float) -> np.ndarray:
    t = (np.arange(points) - (points - 1) / 2) / width
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2)


@_add(
    EFFICIENT,
    "cwt_coefficients",
    [label("cwt_coefficients", widths=WIDTHS, coeff=k, w=w) for w in WIDTHS for k in CWT_COEFFS],
)
def cwt_coefficients(x):
    out = []
    for w in WIDTHS:
        out += padded(np.convolve(x, ricker(min(10 * w, len(x)), w)[::-1], mode="same"), CWT_COEFFS)
    return out


@_add(EFFICIENT, "augmented_dickey_fuller", [label("augmented_dickey_fuller", attr=a) for a in ("teststat", "pvalue", "usedlag")])
def augmented_dickey_fuller(x):
    result = ols.adf(x)
    return [NAN] * 3 if result is None else [result[0], ols.p_value(result[0]), float(result[1])]


@_add(EFFICIENT, "lempel_ziv_complexity", [label("lempel_ziv_complexity", bins=b) for b in ENTROPY_BINS])
def lempel_ziv_complexity(x):
    """Distinct phrases of the binned sequence, each the shortest not seen yet."""
    out = []
    for b in ENTROPY_BINS:
        symbols = np.searchsorted(np.linspace(x.min(), x.max(), b + 1)[1:], x, side="left").tolist()
        seen, phrase = set(), ()
        for s in symbols:
            phrase += (s,)
            if phrase not in seen:
                seen.add(phrase)
                phrase = ()
        out.append(len(seen) / len(x))
    return out


def drift_polynomial(x: np.ndarray) -> np.ndarray:
    """Cubic through the mean step of each value bin (deterministic dynamics)."""
    nothing = np.full(DRIFT_DEGREE + 1, NAN)
    if len(x) < 3:
        return nothing
    at, step = x[:-1], np.diff(x)
    edges = np.quantile(at, np.linspace(0, 1, DRIFT_BINS + 1))
    if np.any(np.diff(edges) <= 0):
        return nothing
    bins = np.clip(np.searchsorted(edges, at, side="left") - 1, 0, DRIFT_BINS - 1)
    used = np.unique(bins)
    if len(used) <= DRIFT_DEGREE:
        return nothing
    means = [(at[bins == b].mean(), step[bins == b].mean()) for b in used]
    return np.polyfit(*zip(*means), DRIFT_DEGREE)


@_add(
    EFFICIENT,
    "friedrich_coefficients",
    [label("friedrich_coefficients", coeff=k, m=DRIFT_DEGREE, r=DRIFT_BINS) for k in range(DRIFT_DEGREE + 1)],
)
def friedrich_coefficients(x):
    return drift_polynomial(x).tolist()


@_add(EFFICIENT, "max_langevin_fixed_point", [label("max_langevin_fixed_point", m=DRIFT_DEGREE, r=DRIFT_BINS)])
def max_langevin_fixed_point(x):
    c = drift_polynomial(x)
    roots = np.roots(c) if np.isfinite(c).all() else np.zeros(0)
    return [float(roots.real.max()) if len(roots) else NAN]


def _matches(x: np.ndarray, length: int, tolerance: float) -> np.ndarray:
    """For each window, how many windows lie within the tolerance everywhere."""
    w = np.lib.stride_tricks.sliding_window_view(x, length)
    return np.array([(np.abs(w - row).max(axis=1) <= tolerance).sum() for row in w], dtype=float)


@_add(COSTLY, "approximate_entropy", [label("approximate_entropy", m=2, r=r) for r in TOLERANCES])
def approximate_entropy(x):
    if len(x) <= 3:
        return [0.0] * len(TOLERANCES)
    phi = lambda m, r: float(np.log(_matches(x, m, r) / (len(x) - m + 1)).mean())
    return [abs(phi(2, r * x.std()) - phi(3, r * x.std())) for r in TOLERANCES]


@_add(COSTLY, "sample_entropy", ["sample_entropy"])
def sample_entropy(x):
    if len(x) < 4:
        return [NAN]
    tolerance = 0.2 * x.std()
    b, a = ((_matches(x, m, tolerance) - 1).sum() for m in (2, 3))
    return [-math.log(a / b) if a > 0 and b > 0 else NAN]


ALL = EFFICIENT | COSTLY


def names_of(names: Sequence[str]) -> list[str]:
    return [n for name in names for n in ALL[name][0]]


def frame_udf(names: tuple[str, ...], max_shift: int | None):
    """(values, reach) of a run -> the numbers of each frame ending in it; the
    first ``reach`` values only lead up to the run."""
    functions = [ALL[n][1] for n in names]

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def frames(series: pd.Series, reach: pd.Series) -> pd.Series:
        def one(values, lead):
            x = np.asarray(values, dtype=float)
            out = []
            for end in range(int(lead) + 1, len(x) + 1):
                start = 0 if max_shift is None else max(0, end - 1 - max_shift)
                window = x[start:end]
                out.append([v if math.isfinite(v) else None for f in functions for v in f(window)])
            return out

        with np.errstate(all="ignore"):
            return pd.Series([one(v, k) for v, k in zip(series, reach)])

    return frames
